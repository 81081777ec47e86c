"""Exact and near-duplicate sentences of a corpus.

Every non-blank line is a sentence. Near pairs are found by an exact set-similarity join: a sentence's distinct tokens
are ordered by how rare they are, and two sentences at Jaccard t or more share one of the first n - ceil(t n) + 1 of
them, early enough in both (setjoin). Joining runs over distinct sentences; occurrences come back at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terseflow.operators import setjoin
from terseflow.semantics import lines_of, trim_space

THRESHOLD = 0.6
#: Occurrences of one sentence that meet their partners in one place; see occurrence_pairs().
BLOCK = 512
#: Kinds of tokens whose frequency is counted together. It orders tokens, so it decides on the work and not on the pairs.
RANKS = 1 << 20


def normalized(sentence: Column) -> Column:
    """Lower case, letters and digits only, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}\s]+", " "), r"\s+", " "))


def fingerprint(sentence: Column) -> Column:
    return F.sha2(normalized(sentence), 256)


def sentences(docs: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """(path, line_no, raw, normalized) of every line that is not blank."""
    rows = docs.select(F.col(path_col).cast("string").alias("path"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
    raw = rows.select("path", (F.col("pos") + 1).cast("long").alias("line_no"), trim_space(F.col("line")).alias("raw")).where("raw <> ''")
    return raw.withColumn("normalized", normalized(F.col("raw")))


def location() -> Column:
    return F.concat("path", F.lit(":"), F.col("line_no").cast("string"))


def sentence_id(text: str = "normalized") -> Column:
    """128 bits of a sentence, to be shuffled in its place."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def duplicate_places(found: DataFrame) -> DataFrame:
    """(id, sentence, place) of every occurrence of sentences that occur twice or more, a row each; the sentence is the first raw form by path and line.

    Sentences are counted before any of their places is moved, so those that occur once cost a counter.
    """
    marked = found.withColumn("id", sentence_id())
    repeated = marked.groupBy("id").agg(F.count("*").alias("n"), F.min_by("raw", F.struct("path", "line_no")).alias("sentence")).where("n > 1")
    return marked.select("id", location().alias("place")).join(repeated.drop("n"), "id")


def exact_duplicates(found: DataFrame) -> DataFrame:
    """(sentence, locations, similarity) of sentences that occur twice or more. A sentence's places are one array here; duplicate_places() has them as rows."""
    groups = duplicate_places(found).groupBy("id").agg(F.first("sentence").alias("sentence"), F.array_sort(F.collect_list("place")).alias("locations"))
    return groups.select("sentence", "locations", F.lit(1.0).alias("similarity"))


def distinct_sentences(found: DataFrame) -> DataFrame:
    """(normalized, words, tokens): one row a sentence."""
    words = F.filter(F.split("normalized", " "), lambda w: w != "")
    return found.select("normalized").distinct().select("normalized", F.size(words).alias("words"), F.array_distinct(words).alias("tokens"))


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union > 0, common / union).otherwise(F.lit(0.0))


def near_pairs_band(found: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(left, right, similarity) of distinct sentences with neighbouring word counts, by a join on the count. Quadratic: the yardstick for small tables."""
    s = distinct_sentences(found)
    a = s.select(F.col("normalized").alias("left"), F.col("tokens").alias("ta"), F.col("words").alias("wa"), F.explode(F.array(F.col("words") - 1, F.col("words"), F.col("words") + 1)).alias("band"))
    b = s.select(F.col("normalized").alias("right"), F.col("tokens").alias("tb"), F.col("words").alias("band"))
    pairs = a.join(b, "band").where("left < right").withColumn("similarity", jaccard(F.col("ta"), F.col("tb")))
    return pairs.where(F.col("similarity") >= threshold).select("left", "right", "similarity")


def token_ranks(hashes: DataFrame) -> Column:
    """How often the tokens of each of RANKS kinds occur, as one array: a scalar subquery. The table holds (h), the hashes of tokens."""
    counts = hashes.groupBy(F.pmod("h", F.lit(RANKS)).alias("kind")).agg(F.count("*").alias("n"))
    kinds = hashes.sparkSession.range(RANKS).select(F.col("id").alias("kind")).join(counts, "kind", "left")
    # one occurrence is rank 0: nothing else has the token
    rank = F.least(F.lit(32767), F.floor(F.log2(F.coalesce("n", F.lit(1))) * 1000)).cast("int")
    return kinds.agg(F.array_sort(F.collect_list(F.struct("kind", rank.alias("rank")))).alias("all")).select(F.transform("all", lambda x: x["rank"])).scalar()


def near_pairs(found: DataFrame, threshold: float = THRESHOLD, neighbours: int | None = 1) -> DataFrame:
    """(left, right, similarity) of distinct sentences at `threshold` or more whose word counts differ by `neighbours` at most (None: by any number).

    Candidates are those of setjoin; only ids are moved for them. Sentences are moved once, to be compared exactly.
    """
    parts = 4 * int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = F.filter(F.split("normalized", " "), lambda w: w != "")
    kept = found.where("normalized <> ''").select("normalized", F.xxhash64("normalized").alias("id"))
    tokens = kept.select("id", F.posexplode(F.array_distinct(words)).alias("pos", "token")).select("id", "pos", F.xxhash64("token").alias("h"))
    rank = F.get(token_ranks(tokens.select("h")), F.pmod("h", F.lit(RANKS)).cast("int")).cast("long")
    code = F.shiftleft(rank, setjoin.TOKEN_BITS).bitwiseOR(F.col("h").bitwiseAND(F.lit((1 << setjoin.TOKEN_BITS) - 1)))
    blocks = tokens.select("id", "pos", code.alias("code")).mapInArrow(setjoin.heads(threshold, parts), "part int, size int, block binary")
    met = blocks.repartitionById(parts, F.col("part")).mapInArrow(setjoin.candidates(threshold), "x long, y long, met int, need int")
    candidates = met.groupBy("x", "y").agg(F.sum("met").alias("met"), F.min("need").alias("need")).where("met >= need").select("x", "y")
    # copies meet in the partition of their id
    texts = kept.repartition(parts, "id").distinct()
    both = candidates.join(texts.toDF("p", "x"), "x").join(texts.toDF("q", "y"), "y")
    split = [F.filter(F.split(c, " "), lambda w: w != "") for c in ("p", "q")]
    if neighbours is not None:
        both = both.where(F.abs(F.size(split[0]) - F.size(split[1])) <= neighbours)
    scored = both.select(F.least("p", "q").alias("left"), F.greatest("p", "q").alias("right"), jaccard(*map(F.array_distinct, split)).alias("similarity"))
    return scored.where(F.col("similarity") >= threshold)


def occurrence_pairs(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """(sentence, first, second) of each two occurrences of the (left, right) of `pairs`: 'a ~ b' and both places, in input order. The other columns of `pairs` come along.

    There may be as many as the product of two sentences' occurrences, so they are made where they are used: occurrences
    of the rarer sentence are sent to those of the other, which lie in blocks of about BLOCK, each in a partition of its own.
    """
    parts = 4 * int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    carried = [c for c in pairs.columns if c not in ("left", "right")]
    at = found.select(sentence_id().alias("id"), F.struct("path", "line_no", "raw").alias("o"), location().alias("place"))
    sizes = at.groupBy("id").agg(F.count("*").alias("n"))
    sided = pairs.select(*carried, sentence_id("left").alias("l"), sentence_id("right").alias("r")).join(sizes.toDF("l", "ln"), "l").join(sizes.toDF("r", "rn"), "r")
    rarer = F.col("ln") <= F.col("rn")
    blocks = F.ceil(F.greatest("ln", "rn") / BLOCK).cast("int").alias("blocks")
    sided = sided.select(*carried, F.when(rarer, F.col("l")).otherwise(F.col("r")).alias("few"), F.when(rarer, F.col("r")).otherwise(F.col("l")).alias("many"), blocks)
    sent = sided.join(at.toDF("few", "x", "px"), "few").select(*carried, "many", "x", "px", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    block = F.pmod(F.xxhash64("y.path", "y.line_no"), F.col("blocks").cast("long")).cast("int").alias("block")
    kept = at.toDF("many", "y", "py").join(sided.select("many", "blocks").distinct(), "many").select("many", "y", "py", block)
    # partitions of a given number, which small sizes in bytes don't fold into a few
    both = sent.repartition(parts, "many", "block").join(kept.repartition(parts, "many", "block"), ["many", "block"])
    later = F.col("x") > F.col("y")
    raws = [F.when(later, F.col(f"{a}.raw")).otherwise(F.col(f"{b}.raw")) for a, b in ("yx", "xy")]
    places = [F.when(later, F.col(f"p{a}")).otherwise(F.col(f"p{b}")) for a, b in ("yx", "xy")]
    return both.select(*carried, F.concat(raws[0], F.lit(" ~ "), raws[1]).alias("sentence"), places[0].alias("first"), places[1].alias("second"))


def near_duplicates(found: DataFrame, threshold: float = THRESHOLD, method: str = "prefix") -> DataFrame:
    """(sentence, locations, similarity) for each pair of occurrences of different sentences at `threshold` or more: 'a ~ b' in input order."""
    pairs = (near_pairs if method == "prefix" else near_pairs_band)(found, threshold)
    return occurrence_pairs(found, pairs).select("sentence", F.array("first", "second").alias("locations"), "similarity")


def report_text(exact: DataFrame, near: DataFrame) -> DataFrame:
    """The report as one string; its size is that of the report, so this is for small corpora."""

    def section(frame: DataFrame, title: str, line: Column, order: Column) -> DataFrame:
        lines = frame.select(F.struct(order.alias("o"), line.alias("l")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("all"))
        body = F.array_join(F.transform("all", lambda x: x["l"]), "\n")
        return lines.select(F.concat(F.lit(f"{title}\n"), F.when(body == "", "- none").otherwise(body)).alias(title))

    where = F.array_join("locations", ", ")
    a = section(exact, "Exact duplicates:", F.concat(F.lit("- "), F.col("sentence"), F.lit(" ["), where, F.lit("]")), F.col("sentence"))
    b = section(near, "Near duplicates:", F.concat(F.lit("- "), F.format_string("%.2f ", F.col("similarity")), F.col("sentence"), F.lit(" ["), where, F.lit("]")), F.struct(-F.col("similarity"), F.col("sentence")))
    return a.crossJoin(b).select(F.concat(F.col("`Exact duplicates:`"), F.lit("\n"), F.col("`Near duplicates:`")).alias("report"))
