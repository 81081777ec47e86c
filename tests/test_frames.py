"""DataFrame operators: corpus pipelines, duplicates, transcripts, runs, sources, streaming and SQL names."""

import json
import os
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from terseflow.functions import classify, metrics, registry
from terseflow.operators import code, corpus, dedup, history, markdown, prose, runs, validate, zones
from terseflow.plans import queries
from terseflow.sources import documents, observe
from terseflow.streaming import tracker


def test_compress_reports_instead_of_raising(spark):
    rows = [("a.md", "Please keep it in order to test."), ("/x/.ssh/a.md", "Please"), ("b.go", "package b"), ("c.md", None), ("d.md", ""), ("a.md", "Please keep it in order to test.")]
    found = prose.compress(spark.createDataFrame(rows, "path string, content string")).collect()
    assert [r.output for r in found] == ["keep it to test.", None, None, None, "", "keep it to test."]
    assert [r.error for r in found] == [None, 'refusing sensitive path "/x/.ssh/a.md"', "compress requires natural language, got code", "no content", None, None]
    assert found[0].changed and not found[4].changed and found[0].stats.inputWords == 7 and found[0].stats.outputBytes == 16


def test_validate_pairs(spark):
    a = spark.createDataFrame([("x", "# A"), ("y", "b")], "path string, content string")
    b = spark.createDataFrame([("x", "# B"), ("z", "c")], "path string, content string")
    r = validate.validate(a, b).select("path", "report.*").collect()
    assert [(x.path, x.valid, x.errors) for x in r] == [("x", False, ["heading mismatch"])]


def test_validation_reads_a_text_once(monkeypatch):
    seen, scan = [], zones.special_regions
    monkeypatch.setattr(zones, "special_regions", lambda text: seen.append(text) or scan(text))
    a, b = "# Head\n~~~\nx /a/b\n~~~\n- i", "# Tail\n~~~\ny\n~~~\ni"
    assert validate.compare(a, b) == (["heading mismatch", "code block mismatch"], ["path mismatch", "bullet count drift"])
    assert seen == [a, b]
    assert validate.compare(a, a) == validate.compare("plain", "plainer") == ([], []) and len(seen) == 2


def test_markdown_ways_agree(spark):
    texts = ["a\n\n\n\n* x\n  + y\n| a |  b |\n```\n\n\n* z\n~~~\nend  ", "", None, "\n\n", "~~~"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    one = {r.id: r.o for r in docs.select("id", markdown.optimized(F.col("content")).alias("o")).collect()}
    two = {r.id: r.output for r in markdown.optimize_markdown(docs, "id", "content").collect()}
    assert one == two
    assert one[0] == "a\n\n- x\n- y\n|a|b|\n```\n\n\n* z\n~~~\nend" and one[1] == "" and one[2] is None and one[3] == ""


def test_dedup_small(spark):
    rows = [("a", "Keep files small.\n\nUse tests\nalpha beta gamma"), ("b", "keep files small\nuse tests!\nalpha beta gamma delta\nuse  tests"), ("c", None)]
    found = dedup.sentences(spark.createDataFrame(rows, "p string, t string"), "p", "t")
    exact = {r.sentence: r.locations for r in dedup.exact_duplicates(found).collect()}
    assert exact == {"Keep files small.": ["a:1", "b:1"], "Use tests": ["a:3", "b:2", "b:4"]}
    near = dedup.near_duplicates(found).collect()
    assert [(r.sentence, r.locations, r.similarity) for r in near] == [("alpha beta gamma ~ alpha beta gamma delta", ["a:4", "b:3"], 0.75)]
    text = dedup.report_text(dedup.exact_duplicates(found), dedup.near_duplicates(found)).first().report
    assert text == "Exact duplicates:\n- Keep files small. [a:1, b:1]\n- Use tests [a:3, b:2, b:4]\nNear duplicates:\n- 0.75 alpha beta gamma ~ alpha beta gamma delta [a:4, b:3]"
    none = found.limit(0)
    assert dedup.report_text(dedup.exact_duplicates(none), dedup.near_duplicates(none)).first().report == "Exact duplicates:\n- none\nNear duplicates:\n- none"


@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.8, 0.9])
def test_prefix_join_equals_band_join(spark, threshold):
    words = "a b c d e f g h".split()
    rows = [(str(i), "\n".join(" ".join(words[(i * 7 + j * k) % 8] for k in range(1 + (i + j) % 6)) for j in range(6))) for i in range(12)]
    found = dedup.sentences(spark.createDataFrame(rows, "p string, t string"), "p", "t")
    assert sorted(dedup.near_pairs(found, threshold).collect()) == sorted(dedup.near_pairs_band(found, threshold).collect())


def test_near_pairs_equal_brute_force(spark):
    """Sets of up to 260 tokens, with edits around the threshold, copies and equal sets; heads of long sets must meet often."""
    rng = random.Random(5)
    lines = []
    for size in (1, 2, 3, 5, 9, 17, 23, 24, 25, 47, 48, 70, 96, 130, 200, 260):
        for _ in range(3):
            base = [f"w{min(int(rng.expovariate(0.004)), 3000)}" for _ in range(size)]
            lines.append(base)
            for share in (0.05, 0.15, 0.22, 0.25, 0.27, 0.3, 0.45):
                lines.append([f"v{rng.random()}" if rng.random() < share else w for w in base if rng.random() > share / 3])
            lines += [base + base[: 1 + size // 3], base[: max(1, round(size * 0.6))], base[: max(1, int(size * 0.6) - 1)]]
    found = dedup.sentences(spark.createDataFrame([(str(i), " ".join(x)) for i, x in enumerate(lines)], "p string, t string"), "p", "t").cache()
    texts = sorted({r.normalized for r in found.collect()} - {""})
    sets = [set(t.split()) for t in texts]
    for threshold in (0.5, 0.6, 0.85):
        expected = set()
        for i, a in enumerate(sets):
            for j in range(i + 1, len(sets)):
                common = len(a & sets[j])
                if common / (len(a) + len(sets[j]) - common) >= threshold:
                    expected.add((texts[i], texts[j]))
        assert len(expected) > 100
        pairs = [(r.left, r.right) for r in dedup.near_pairs(found, threshold, neighbours=None).collect()]
        assert set(pairs) == expected and len(pairs) == len(expected)


def test_near_sentence_pairs_of_any_word_counts(spark, tmp_path):
    rows = [(1, "one two three four five six"), (2, "one two three four"), (3, "one two three four five six six six six")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.left, r.right): r.similarity for r in queries.near_sentence_pairs(spark, str(tmp_path)).collect()}
    assert found == {(rows[1][1], rows[0][1]): 0.666667, (rows[0][1], rows[2][1]): 1.0, (rows[1][1], rows[2][1]): 0.666667}


def test_occurrences_of_one_pair_are_spread(spark):
    rows = [(f"a{i}", "alpha beta gamma") for i in range(3000)] + [(f"b{i}", "alpha beta gamma delta") for i in range(20)] + [("c", "Alpha  beta gamma!")]
    found = dedup.sentences(spark.createDataFrame(rows, "p string, t string"), "p", "t")
    near = dedup.near_duplicates(found).withColumn("task", F.spark_partition_id()).collect()
    assert len({tuple(r.locations) for r in near}) == len(near) == 3001 * 20
    assert {r.sentence for r in near} == {"alpha beta gamma ~ alpha beta gamma delta", "alpha beta gamma delta ~ Alpha  beta gamma!"}
    assert len({r.task for r in near}) > 1


def test_history_json(spark):
    calls = [{"content": "Show <it>.", "role": "user"}, {"role": "tool", "content": "FAIL\\nFAIL\\n\\nFAIL", "toolName": "sh"}, {"role": "t", "content": "1", "toolName": "r", "filePath": "f"}, {"role": "t", "content": "2", "toolName": "r", "filePath": "f"}, {"role": "t", "content": "\n".join(map(str, range(50))), "toolName": "r"}]
    rows = [("a", json.dumps(calls)), ("b", "[]"), ("c", "not json"), ("d", '{"role": "x"}'), ("e", None)]
    found = {r.id: r for r in history.compact_history_json(spark.createDataFrame(rows, "id string, doc string"), "id", "doc").collect()}
    out = json.loads(found["a"].output)
    assert [m["content"] for m in out[:3]] == ["Show <it>.", "FAIL x3", "2"] and list(out[0]) == ["role", "content"]
    assert out[3]["content"].split("\n")[20] == "... 10 lines omitted ..." and len(out[3]["content"].split("\n")) == 41
    assert found["b"].output == "[]" and all(found[k].error == "malformed transcript" for k in "cde")


def test_smart_read(spark):
    long_ts = "function f() {\n  return 1;\n}\n" * 80
    rows = [("a.md", "short"), ("b.md", "Please go\n" * 200), ("c.ts", long_ts), ("d.json", "[1,\n" + "\n" * 250 + "2]"), ("e.json", "x\n" * 250), ("f.py", "x = 1\n" * 250), (".aws/x", "k")]
    found = {r.path: r for r in corpus.smart_read(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert found["a.md"].findings == ["passthrough=below_threshold"] and found["a.md"].output == "short"
    assert found["b.md"].output == "go\n" * 200 or found["b.md"].output.startswith("go")
    assert found["c.ts"].output.startswith("function f();") and found["c.ts"].findings == ["classification=code"]
    assert found["d.json"].output == "[1,2]" and found["e.json"].findings == ["classification=config", "passthrough=reduction_failed"]
    assert found["f.py"].findings == ["classification=code", "passthrough=unsupported_reducer"] and found[".aws/x"].error


def test_maintain(spark):
    rows = [("a.md", "Please keep it.\nsame line here"), ("b.md", "same line here"), ("c.go", "package c"), ("x/.env", "k")]
    docs, findings, summary = corpus.maintain(spark.createDataFrame(rows, "path string, content string"))
    said = [r.finding for r in findings.orderBy("part", "key", "pos").collect()]
    assert said[0].startswith("compressed a.md: saved 7 bytes") and said[1:] == ["skip c.go: classification=code", 'exact duplicate: "same line here" in [a.md:2, b.md:1]']
    assert summary.first().summary.startswith("maintain: 3 files scanned, 1 changed, saved 7 bytes")
    assert corpus.maintain(spark.createDataFrame([], "path string, content string"))[2].first().summary == "no eligible files found"


def test_classification(spark):
    rows = [("a.MD", "x", "skip"), ("a", '{"a":1}', "config"), ("a", "[1] x", "natural_language"), ("a", "k: v", "config"), ("a", "#k: v\nfunc f", "code"), ("a", " ", "skip"), ("d/.b/c", "text", "natural_language"), ("x.rs", "", "code")]
    found = spark.createDataFrame(rows, "p string, t string, k string").withColumn("found", classify.classification(F.col("p"), F.col("t"))).collect()
    assert [r.found for r in found] == [r.k for r in found]
    paths = {"a/../.ssh/k": True, "credentials": True, "x/./.env": True, "a.ssh/b": False, "/.aws": True, "env": False, "a/.ssh/../b": False}
    frame = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.s for r in frame.select("p", classify.is_sensitive_path(F.col("p")).alias("s")).collect()} == paths


def test_metrics(spark, tmp_path, monkeypatch):
    row = spark.createDataFrame([("né 😀\u00a0b", None)], "t string, n string")
    x = row.select(metrics.word_count(F.col("t")).alias("w"), metrics.truncated(F.col("t"), 2).alias("c"), metrics.token_counts(F.col("n")).alias("k")).first()
    assert (x.w, x.k) == (3, None) and x.c == "n\n... [truncated 9 bytes] ..."
    assert metrics.token_backend() == "approximate" and metrics.token_backend("/x/r.tiktoken") == "ranks:r.tiktoken"
    assert metrics.approximate_tokens("") == 0 and metrics.approximate_tokens("Hello, world!") == 4


def test_runs(spark):
    t = datetime(2026, 3, 1)
    sizes = [f"{a}_{b} long" for b in runs.SIZES for a in ("in", "out")]
    rows = [("a", t, True, 60, 12, 9, 1, 20, 9), ("b", t + timedelta(days=40), False, 5, 5, 1, 1, 3, 3)]
    frame = spark.createDataFrame(rows, "command string, started_at timestamp, success boolean, " + ", ".join(sizes))
    s = runs.run_summary(frame).first()
    assert (s.runs, s.successful, s.failed, s.bytes_saved, s.words_saved, s.tokens_saved) == (2, 1, 1, 48, 8, 11)
    assert [r.month for r in runs.monthly_trend(frame).collect()] == ["2026-03", "2026-04"]
    shown = runs.trend_display(runs.monthly_trend(frame)).orderBy("month").collect()
    assert [(r.bar_width, r.note) for r in shown] == [(100, "steady savings"), (0, "flat month")]
    assert [r.value for r in runs.outcome_context(frame).orderBy("place").collect()] == ["50%", "a", "2026-03"]
    assert runs.outcome_context(frame.limit(0)).count() == 0 and runs.run_summary(frame.limit(0)).first().runs == 0


def test_events(spark):
    t = datetime(2026, 3, 1)
    rows = [("1", "finished", t, 1), ("1", "started", t, 2), ("2", "started", t - timedelta(seconds=60), 3), ("3", "started", t, 4)]
    events = spark.createDataFrame(rows, "id string, kind string, started_at timestamp, arrival long")
    now = F.lit(t)
    assert {r.id: r.kind for r in runs.latest_events(events).collect()}["1"] == "started"
    latest = runs.latest_events(events, rank_kinds=True)
    assert {r.id: r.status for r in runs.with_status(latest, now).collect()} == {"1": "finished", "2": "stale", "3": "started"}
    assert runs.active_count(latest, now).first().active == 1
    assert [r.id for r in runs.snapshot(latest, 2).collect()] == ["3", "1"]


def test_sources(spark, tmp_path):
    (tmp_path / "d/.ssh").mkdir(parents=True)
    (tmp_path / "d/a.md").write_text("né")
    (tmp_path / "d/.ssh/k").write_text("no")
    assert [(os.path.basename(r.path), r.content) for r in documents.read_corpus(spark, f"{tmp_path}/d").collect()] == [("a.md", "né")]
    (tmp_path / "link").symlink_to(tmp_path / "d/.ssh/k")
    (tmp_path / "broken").symlink_to(tmp_path / "nowhere")
    assert [documents.is_sensitive_resolved(str(tmp_path / p)) for p in ("link", "broken", "d/a.md", "missing")] == [True, True, False, False]
    path = str(tmp_path / "d/a.md")
    documents.write_with_backup(path, "né", "new")
    assert open(path).read() == "new" and open(f"{path}.bak").read() == "né"
    (tmp_path / "h.jsonl").write_text('{"id": "1", "command": "x", "success": true, "stats": {"inputBytes": 3}}\n')
    assert documents.read_history(spark, f"{tmp_path}/h.jsonl").first().stats.inputBytes == 3
    (tmp_path / "bad.jsonl").write_text("{oops\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        documents.read_history(spark, f"{tmp_path}/bad.jsonl").collect()


def test_results(spark):
    row = spark.sql("select true as c, array('w<') as f, '' as o, named_struct('inputBytes', 1L) as s")
    result = documents.result_struct("x", F.col("c"), F.col("s"), F.lit(False), F.col("f"), F.col("o"))
    r = row.select(documents.result_json(result).alias("j"), documents.result_text(result).alias("t")).first()
    assert r.j == '{"command":"x","changed":true,"stats":{"inputBytes":1},"producedOutput":false,"findings":["w\\u003c"]}'
    assert r.t == "x changed=true\n\nFindings:\n  - w<\n"


def test_stream_equals_batch(spark, tmp_path):
    t = datetime.now().replace(microsecond=0)
    rows = [(str(i % 7), "c", "finished" if i > 14 else "started", t + timedelta(seconds=i), i, True) for i in range(20)]
    schema = "id string, command string, kind string, started_at timestamp, arrival long, success boolean"
    events = spark.createDataFrame(rows, schema)
    for k in range(2):
        events.where(F.col("arrival").between(k * 10, k * 10 + 9)).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = tracker.track_runs(stream).writeStream.foreachBatch(tracker.recent_table(f"{tmp_path}/recent", 5)).option("checkpointLocation", f"{tmp_path}/cp").start()
    seen, end = 0, time.time() + 90  # it never settles while timeouts are open
    while seen < 20 and query.isActive and time.time() < end:
        time.sleep(0.5)
        seen = sum({p.batchId: p.numInputRows for p in query.recentProgress}.values())
    query.stop()
    done = max(int(p.split("=")[1]) for p in os.listdir(f"{tmp_path}/recent") if "=" in p and os.path.exists(f"{tmp_path}/recent/{p}/_SUCCESS"))
    found = {r.id: r.status for r in spark.read.parquet(f"{tmp_path}/recent/batch={done}").collect()}
    batch = {r.id: r.kind for r in runs.snapshot(runs.latest_events(events, rank_kinds=True), 5).collect()}
    assert found == batch


def test_months_are_those_of_utc(spark):
    at = datetime(2026, 3, 31, 23, 30)
    frame = spark.createDataFrame([("a", at, True, 60, 12, 9, 1, 20, 9)], "command string, started_at timestamp_ntz, success boolean, " + ", ".join(f"{a}_{b} long" for b in runs.SIZES for a in ("in", "out")))
    instants = frame.withColumn("started_at", F.expr("timestamp '2026-03-31 23:30:00Z'"))
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Asia/Tokyo", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert runs.monthly_trend(frame).first().month == runs.monthly_trend(instants).first().month == "2026-03"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_monthly_sums_of_a_stream_keep_late_ends(spark, tmp_path):
    t = datetime(2026, 5, 1)
    rows = [("1", "finished", t, True, 50, 20), ("1", "finished", t, True, 50, 20), ("2", "started", t, True, 1, 1), ("3", "failed", t, False, 7, 7), ("4", "finished", t - timedelta(days=200), True, 9, 4)]
    schema = "id string, kind string, started_at timestamp, success boolean, in_bytes long, out_bytes long"
    for k, row in enumerate(rows):  # the oldest comes last
        spark.createDataFrame([row], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = tracker.monthly_counts(stream).writeStream.format("memory").queryName("months").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    assert query.awaitTermination(120)
    found = {r.month: (r.runs, r.successful, r.bytes_saved) for r in spark.table("months").collect()}
    assert found == {"2026-05": (2, 1, 30), "2025-10": (1, 1, 5)}


def test_tokens_by_ranks(spark):
    ranks = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    if not os.path.exists(ranks):
        pytest.skip("no ranks file here")
    texts = ["", "Hello, world!", "né 😀 tokenisation of 12345 words\n\n\tand tabs", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r.n for r in frame.select(metrics.token_counts(F.col("t"), ranks).alias("n")).collect()]
    one = metrics._encoder(ranks)
    assert found == [None if t is None else len(one.encode_ordinary(t)) for t in texts] and found[0] == 0 and found[1] >= 3
    assert one.decode(one.encode_ordinary(texts[2])) == texts[2]


def test_links_and_order(spark, tmp_path):
    (tmp_path / "d/.ssh").mkdir(parents=True)
    (tmp_path / "d/.ssh/id_rsa").write_text("secret")
    for name in ("b.md", "a.md", "c.md"):
        (tmp_path / "d" / name).write_text(name)
    (tmp_path / "d/innocent.md").symlink_to(tmp_path / "d/.ssh/id_rsa")
    found = documents.read_corpus(spark, f"{tmp_path}/d", in_order=True).collect()
    assert [os.path.basename(r.path) for r in found] == ["a.md", "b.md", "c.md"]


def test_paths_of_tools(spark):
    paths = {r"C:\u\.ssh\id": True, r"a\b\.env": True, "a/.aws\\x": True, r"C:\u\ssh": False, ".env": True, r"x\.env.txt": False}
    frame = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.s for r in frame.select("p", classify.is_sensitive_path(F.col("p"), backslashes=True).alias("s")).collect()} == paths


def test_observed_runs(spark, tmp_path):
    (tmp_path / "in.md").write_text("text")
    (tmp_path / "id_rsa").write_text("secret")
    log = observe.RunLog(f"{tmp_path}/log")
    done = observe.observe(log, "compress", lambda: observe.Outcome("out", True, {"inputBytes": 9, "outputBytes": 3}), [f"{tmp_path}/in.md", f"{tmp_path}/missing"], "test")
    assert done.output == "out"
    with pytest.raises(ValueError, match="broken"):
        observe.observe(log, "dedup", lambda: (_ for _ in ()).throw(ValueError("broken")), [f"{tmp_path}/id_rsa"])
    end = time.time() + 10
    while time.time() < end and len(os.listdir(f"{tmp_path}/log/events")) < 4:
        time.sleep(0.05)
    events = spark.read.schema(documents.EVENT).json(f"{tmp_path}/log/events").orderBy("startedAt", F.col("kind").desc()).collect()
    assert [(r.kind, r.command, r.payloadStatus) for r in events] == [("started", "compress", "observed"), ("finished", "compress", "observed"), ("started", "dedup", "redacted"), ("failed", "dedup", "redacted")]
    assert events[1].input == f"=== {tmp_path}/in.md ===\ntext" and events[1].resultSummary == "changed=true, saved 6 bytes, 0 words, 0 approx tokens" and events[1].result.output == "out"
    assert events[3].error == "broken" and not events[3].success and events[3].input is None
    history = documents.read_history(spark, f"{tmp_path}/log/history").orderBy("startedAt").collect()
    assert [(r.command, r.success) for r in history] == [("compress", True), ("dedup", False)] and history[0].stats.inputBytes == 9


def test_a_log_that_fails_costs_nothing(tmp_path, monkeypatch):
    (tmp_path / "file").write_text("in the way")
    began = time.perf_counter()
    assert observe.observe(observe.RunLog(f"{tmp_path}/file/log"), "x", lambda: observe.Outcome("kept")).output == "kept"
    monkeypatch.setattr(observe.RunLog, "write", lambda *a: time.sleep(0.75))
    assert observe.observe(observe.RunLog(str(tmp_path)), "x", lambda: observe.Outcome("kept")).output == "kept"
    assert time.perf_counter() - began < 1
    assert observe.input_payload([]) == ("", "none") and observe.input_payload(["", str(tmp_path)]) == ("", "unavailable")
    assert observe.shortened("é" * 10, 3) == "é\n... [truncated 17 bytes] ..."


def test_recent_runs_and_diagnostics(spark, tmp_path):
    (tmp_path / "recent.json").write_text('[{"id": "1", "kind": "started"}, {"id": "2", "kind": "failed", "error": "e"}]')
    assert [(r.id, r.kind, r.error) for r in documents.read_recent(spark, f"{tmp_path}/recent.json").orderBy("id").collect()] == [("1", "started", None), ("2", "failed", "e")]
    for message in ("one", "two"):
        documents.record_diagnostic(spark, f"{tmp_path}/diagnostics", message)
    assert sorted(r.message for r in spark.read.json(f"{tmp_path}/diagnostics").collect()) == ["one", "two"]


def test_details_and_payload_status(spark):
    rows = [(0, False, True, None, None), (2, True, True, "", ""), (1, False, False, "out", None), (1, False, True, None, "e")]
    frame = spark.createDataFrame(rows, "n int, bad boolean, ok boolean, output string, error string").withColumn("s", runs.payload_status(F.col("n"), F.col("bad"), F.col("ok")))
    found = frame.select("s", runs.has_details(F.col("s"), F.col("output"), F.col("error")).alias("d")).collect()
    assert [tuple(r) for r in found] == [("none", False), ("redacted", True), ("unavailable", True), ("observed", True)]


def test_sql_names(spark):
    assert "compress_text" in registry.register(spark)
    assert spark.sql("select compress_text('Please go') as x").first().x == "go"
    assert [r.kind for r in spark.sql("select * from zone_rows('# H\\nsee /p')").collect()] == ["heading", "prose", "path"]
    assert code.skeleton(".ts", "")[0] == ""


def test_every_query_has_rows_or_sql():
    assert set(queries.SQL) <= set(queries.QUERIES)
