"""Line dedup by a suffix array over line-ID sequences, made by distributed prefix doubling.

The corpus is a sequence of line IDs, cut at document ends.  Doubling ranks every position by the
1, 2, 4, ... lines that begin there: the pair of ranks at p and p + 2^k is sorted into one rank, over
all positions at once, until no rank is shared.  Positions with one rank are an interval of the suffix array whose longest common
prefix is at least that deep.  Depths up to `min_lines` that aren't powers of two are ranked too, from two overlapping ranks.

A later copy is the run of lines from a position that isn't its interval's first.  Of all intervals a position
lies in, the deepest counts, and the run against that interval's first position is as long as their common prefix, which is found by
descending the ranks.  Heads of runs are positions whose predecessor isn't a later copy of the predecessor of the same
first position; all other runs lie within a head's.  A run is deleted if it has `min_lines` lines, or fewer with `long_line`
words in all.  The first copy stays.

Positions whose rank is unique leave at once, and a rank that very many positions share is dealt to tasks by salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._work import Work, salt_of
from .decisions import keyed, text_sha

#: Lines from which a repeated run is deleted, and words from which a repeated run of fewer lines is.
MIN_LINES, LONG_LINE = 3, 40
#: Scripts written without blanks, and how many of their characters count as a word.
UNSPACED = r"[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}]+"
UNSPACED_WORD = 2

_AT = ["doc", "uid", "pos"]


def _ranked(work: Work, rows: DataFrame, keys: list[str], name: str, by: list[str] | None = None) -> DataFrame:
    """rows whose keys occur more than once, with rank (in the keys' order, dealt by the first ones of them), first (the first position) and later (whether it's another)."""
    rows = work.save(rows.withColumn("salt", salt_of("uid", "pos")), f"{name}_rows")
    first = F.min(F.struct(F.col("doc").isNull().alias("last"), *_AT))
    some = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), first.alias("first"), F.collect_set("salt").alias("salts")).filter("n > 1")
    some = work.save(some, f"{name}_keys")
    # Range partitions in order, sorted: the running number is a rank over the whole corpus.
    ranks = some.repartitionByRange(*(by or keys)).sortWithinPartitions(*keys).withColumn("rank", F.monotonically_increasing_id())
    ranks = work.save(ranks.select(*keys, "rank", F.col("first.uid").alias("fuid"), F.col("first.pos").alias("fpos"), F.explode("salts").alias("salt")), f"{name}_ranks")
    later = ~((F.col("fuid") == F.col("uid")) & (F.col("fpos") == F.col("pos")))
    out = work.save(rows.join(ranks.hint("merge"), [*keys, "salt"]).select(*_AT, "words", "rank", "fuid", "fpos", later.alias("later")), name)
    for x in ("rows", "keys", "ranks"):
        work.drop(f"{name}_{x}")
    return out


def _beside(left: DataFrame, right: DataFrame, by: int) -> DataFrame:
    """Positions with left's rank a at p and right's rank b at p + by, where both are shared; words of both."""
    right = right.select("uid", (F.col("pos") - by).alias("pos"), F.col("rank").alias("b"), F.col("words").alias("more"))
    both = left.select(*_AT, "words", F.col("rank").alias("a")).join(right.hint("merge"), ["uid", "pos"])
    return both.select(*_AT, (F.col("words") + F.col("more")).alias("words"), "a", "b")


def line_words(line: Column) -> Column:
    """Words between blanks; characters of scripts without blanks count besides, UNSPACED_WORD to the word."""
    between = F.size(F.split(F.trim(line), r"\s+"))
    unspaced = F.floor(F.length(F.regexp_replace(line, UNSPACED, "")) / UNSPACED_WORD).cast("int")
    return F.when(F.octet_length(line) == F.length(line), between).otherwise(between + unspaced)


def _lines(heads: DataFrame) -> DataFrame:
    each = heads.select(F.col("doc_id").alias("doc"), "uid", F.posexplode("x").alias("pos", "line"))
    return each.select(*_AT, "line.h", "line.said")


def ranks(work: Work, heads: DataFrame, min_lines: int) -> dict[int, DataFrame]:
    """depth -> the positions whose run of that many lines is repeated, with their ranks.

    Lines are compared by content: a hash only tells which lines can't be repeated at all.
    """
    lines = _lines(heads)
    shared = lines.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.collect_set(salt_of("uid", "pos")).alias("salts")).filter("n > 1")
    shared = work.save(shared.select("h", F.explode("salts").alias("salt")), "shared")
    known = lines.withColumn("salt", salt_of("uid", "pos")).join(shared.hint("merge"), ["h", "salt"], "left_semi")
    # Hashes deal the lines evenly, and keep the range bounds short.
    known = known.select(*_AT, line_words(F.col("said")).alias("words"), "h", "said")
    at = {1: _ranked(work, known, ["h", "said"], "depth1", ["h"])}
    work.drop("shared")
    depth, power = 1, 1
    while True:
        depth = depth + 1 if depth < min_lines else 2 * power
        at[depth] = _ranked(work, _beside(at[power], at[depth - power], power), ["a", "b"], f"depth{depth}")
        if at[depth].isEmpty():
            break
        if depth == 2 * power:
            power = depth
    return at


def _run_heads(at: dict[int, DataFrame]) -> DataFrame:
    """doc, uid, pos, fuid, fpos, depth, words: later copies at their greatest ranked depth that don't continue the one before them."""
    every = None
    for depth, rows in at.items():
        got = rows.filter("later").select("uid", "pos", F.struct(F.lit(depth).alias("depth"), "fuid", "fpos", "words", "doc").alias("m"))
        every = got if every is None else every.unionByName(got)
    deepest = every.groupBy("uid", "pos").agg(F.max("m").alias("m")).select("uid", "pos", "m.*")
    w = Window.partitionBy("uid").orderBy("pos")
    goes_on = (F.lag("pos").over(w) == F.col("pos") - 1) & (F.lag("fuid").over(w) == F.col("fuid")) & (F.lag("fpos").over(w) == F.col("fpos") - 1)
    return deepest.withColumn("on", F.coalesce(goes_on, F.lit(False))).filter("not on").drop("on")


def _extended(found: DataFrame, at: dict[int, DataFrame]) -> DataFrame:
    """found with length: how many lines run and first copy have in common, which is less than the next ranked depth."""
    found = found.withColumn("length", F.col("depth"))
    depths = sorted(at)
    exact = F.col("depth").isin([a for a, b in zip(depths, depths[1:], strict=False) if b == a + 1])
    done, rest = found.filter(exact), found.filter(~exact)
    for k in sorted((d for d in at if d & (d - 1) == 0), reverse=True):
        here = at[k].select("uid", F.col("pos").alias("end"), F.col("rank").alias("r")).hint("merge")
        there = at[k].select(F.col("uid").alias("fuid"), F.col("pos").alias("fend"), F.col("rank").alias("fr")).hint("merge")
        ends = rest.withColumn("end", F.col("pos") + F.col("length")).withColumn("fend", F.col("fpos") + F.col("length"))
        both = ends.join(here, ["uid", "end"], "left").join(there, ["fuid", "fend"], "left")
        more = F.when((F.col("depth") > k) & (F.col("r") == F.col("fr")), k).otherwise(0)
        rest = both.withColumn("length", F.col("length") + more).select(done.columns)
    return done.unionByName(rest)


def _found(docs: DataFrame, min_lines: int, long_line: int) -> tuple[DataFrame, DataFrame]:
    """(heads: doc_id, sha, uid and x, an element per line; the runs to delete: uid, pos, length, fuid, fpos)."""
    work = Work(docs.sparkSession, "lines")
    split = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    cut = F.transform(split, lambda s: F.struct(F.xxhash64(s).alias("h"), s.alias("said")))
    heads = work.save(docs.select("doc_id", text_sha().alias("sha"), F.monotonically_increasing_id().alias("uid"), cut.alias("x")), "heads")
    at = ranks(work, heads, min_lines)
    found = work.save(_run_heads(at), "run_heads")
    # Below min_lines every depth is ranked, so that words are the whole run's there.
    found = work.save(_extended(found, at).filter((F.col("length") >= min_lines) | (F.col("words") >= long_line)), "runs")
    for depth in at:
        work.drop(f"depth{depth}")
    return heads, found


def runs(docs: DataFrame, min_lines: int = MIN_LINES, long_line: int = LONG_LINE) -> DataFrame:
    """doc_id, uid, first, length, words, first_uid, first_line: the later copies of maximal runs of lines that are deleted, where
    each begins and where its first copy does.  uid numbers the input rows.  Runs may overlap; docs without any have no row."""
    heads, found = _found(docs, min_lines, long_line)
    said = heads.select("doc_id", "uid", F.transform("x", lambda v: line_words(v["said"])).alias("each"))
    words = F.aggregate(F.slice("each", F.col("pos") + 1, F.col("length")), F.lit(0), lambda a, v: a + v)
    rows = found.select("uid", "pos", "length", "fuid", "fpos").join(said.hint("merge"), "uid")
    return rows.select("doc_id", "uid", F.col("pos").alias("first"), "length", words.alias("words"), F.col("fuid").alias("first_uid"), F.col("fpos").alias("first_line"))


def repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, long_line: int = LONG_LINE) -> DataFrame:
    """One row per input row: doc_id, sha, uid, lines (how many), deleted (line numbers from 0, sorted).

    Documents are in the order of doc_id, null last; of rows with one doc_id, in that of the input.
    A line is deleted if it lies in a run of lines that has begun earlier in that order, and the run has
    `min_lines` lines, or fewer with at least `long_line` words in all.  Lines end at line feeds and
    are compared by content; a null text is one empty line.  Other columns aren't read.
    """
    heads, found = _found(docs, min_lines, long_line)
    gone = found.groupBy("uid").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.expr("sequence(pos, pos + length - 1)"))))).alias("deleted"))
    out = heads.select("doc_id", "sha", "uid", F.size("x").alias("lines")).join(gone.hint("merge"), "uid", "left")
    return out.select("doc_id", "sha", "uid", "lines", F.coalesce("deleted", F.array().cast("array<int>")).alias("deleted"))


def drop_repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, long_line: int = LONG_LINE) -> DataFrame:
    """docs, all columns, with text less its deleted lines; other columns, of any name, as they were.

    Rows that agree in doc_id and text are told apart by their order only: the last ones lose lines.
    """
    work = Work(docs.sparkSession, "drop-lines")
    found = repeated_lines(docs, min_lines, long_line).filter("size(deleted) > 0")
    found = found.groupBy(F.col("doc_id").alias("rid"), F.col("sha").alias("rsha")).agg(F.sort_array(F.collect_list(F.struct((-F.col("uid")).alias("o"), "deleted"))).alias("cuts"))
    found = work.save(found, "found").hint("merge")
    rows = keyed(docs)
    on = rows["id"].eqNullSafe(found["rid"]) & (rows["sha"] == found["rsha"])
    same = rows.join(found, on, "left_anti").select("row.*")
    nth = F.row_number().over(Window.partitionBy("id", "sha").orderBy("sha"))
    cut = rows.join(found, on).withColumn("deleted", F.get("cuts.deleted", nth - 1))
    kept = F.filter(F.transform(F.split("row.text", "\n", -1), lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda x: ~F.array_contains(F.col("deleted"), x["i"]))
    text = F.when(F.col("deleted").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(kept, lambda x: x["s"]), "\n"))
    return same.unionByName(cut.withColumn("row", F.col("row").withField("text", text)).select("row.*"))
