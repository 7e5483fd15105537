"""Benchmark decontamination by a positional inverted index.  DataFrame operations only.

The corpus is indexed once: for the rarest terms of the benchmark's windows, by frequency in the
corpus, the index stores every (document, position) with the words around it.  A window's posting lists are
shifted by the terms' offsets and intersected from the rarest term on.  A posting's neighbours are the other terms' lists as far as
they matter to it: a posting goes on only if enough of the window's terms stand where the window would stand, give or take a few words.  Those are the
proximity matches.  Where the lists of all probed terms meet at one start and every word agrees, the match is exact.

As a proximity match lacks at most so many of a window's terms, one more probed term finds every one.  Corpus rows never
meet each other; benchmark windows are taken in blocks of a bounded number, one block after another, so what is broadcast doesn't grow with either table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._work import Work, ascii_lower
from .decisions import keep_rows, text_sha

#: What stands between words, after A-Z has been lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: Proximity: the share of a window's distinct terms, and how many words they may be off their places.
SHARE, SLACK = 0.8, 4
#: Windows that are broadcast at a time (of WINDOW words each), and words in the frequency pass.
BLOCK, WORDS_BLOCK = 1 << 15, 1 << 17


def words_of(col: Column | str) -> Column:
    """Splitting between words takes a fifth of the time that extracting them does."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(col, F.lit(""))), BETWEEN), "")


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, phrase (array): the distinct windows of each item; an item of fewer words is one window.

    Null and wordless texts have none.
    """
    words = items.select("item_id", words_of("text").alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    return words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, size))).alias("phrase")).distinct()


def _key() -> list[Column]:
    return [F.col("doc_id"), text_sha().alias("sha")]


def _blocks(work: Work, df: DataFrame, order: str, most: int, name: str) -> list[DataFrame]:
    """df in blocks of at most about `most` rows each, dealt by hash."""
    n = max(1, -(-df.count() // most))
    if n == 1:
        return [work.save(df, name)]
    saved = work.save(df.withColumn("block", F.pmod(F.xxhash64(order), F.lit(n))), name)
    return [saved.filter(F.col("block") == b).drop("block") for b in range(n)]


def _one_by_one(work: Work, blocks: list[DataFrame], make, name: str) -> DataFrame:
    """The union of what make gives for each block.  Each is written before the next begins, so that one block at a time is broadcast."""
    out = None
    for k, block in enumerate(blocks):
        got = make(block, k)
        if len(blocks) > 1:
            got = work.save(got, f"{name}{k}")
        out = got if out is None else out.unionByName(got)
    return out


def term_counts(work: Work, docs: DataFrame, blocks: list[DataFrame]) -> DataFrame:
    """term, df: occurrences in all documents, of the terms of the blocks."""
    said = docs.select(F.explode(words_of("text")).alias("term"))

    def counted(block: DataFrame, k: int) -> DataFrame:
        return said.join(F.broadcast(block.select("term")), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    return work.save(_one_by_one(work, blocks, counted, "df_"), "df")


def _index(work: Work, docs: DataFrame, blocks: list[DataFrame], reach: int) -> DataFrame:
    """doc_id, sha, term, at, words (of the document), around (the words up to `reach` away) and from (the place of the
    first of them), for the terms of the blocks.

    Every document has one more row with the term '' at -1.
    """
    tokens = docs.select(*_key(), words_of("text").alias("w"))
    each = tokens.select("doc_id", "sha", "w", F.posexplode(F.concat(F.array(F.lit("")), F.col("w"))).alias("p", "term"))
    head = docs.sparkSession.range(1).select(F.lit("").alias("term"))
    at, begin = F.col("p") - 1, F.greatest(F.col("p") - 1 - reach, F.lit(0))
    around = F.when(F.col("term") != "", F.slice("w", begin + 1, at + reach + 1 - begin))

    def posted(block: DataFrame, k: int) -> DataFrame:
        mine = block.select("term")
        got = each.join(F.broadcast(mine if k else mine.unionByName(head)), "term")
        return got.select("doc_id", "sha", "term", at.alias("at"), F.size("w").alias("words"), around.alias("around"), begin.alias("from"))

    return work.save(_one_by_one(work, blocks, posted, "index_"), "index")


def probes(phrases: DataFrame, df: DataFrame, share: float) -> DataFrame:
    """wid, phrase, need, lists, off, term, rank: of each window the rarest terms, so many that a passage with `need` of its
    terms has one of them; lists is their number."""
    distinct = F.size(F.array_distinct("phrase"))
    need = F.ceil(distinct * share - 1e-9).cast("int")
    each = phrases.select("wid", "phrase", need.alias("need"), (distinct - need + 1).alias("lists"), F.posexplode("phrase").alias("off", "term"))
    each = each.groupBy("wid", "term").agg(F.min("off").alias("off"), *[F.first(c).alias(c) for c in ("phrase", "need", "lists")])
    rank = F.row_number().over(Window.partitionBy("wid").orderBy(F.coalesce("df", F.lit(0)), "off"))
    return each.join(df, "term", "left").withColumn("rank", rank).filter(F.col("rank") <= F.col("lists")).drop("df")


def matches(docs: DataFrame, items: DataFrame, size: int = WINDOW, share: float = SHARE, slack: int = SLACK, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(heads, found, near, owners): heads has doc_id, sha, n_words per distinct document; found has
    doc_id, sha, wid, start, length for every exact occurrence of a window; near has doc_id, sha, wid, terms (the most of the window's distinct
    terms in one passage) for windows of which a share of the terms stands together; owners has wid, item_id.

    A passage is where the window would stand by the place of one of its rarest terms, with `slack` words more on either side.
    Exact occurrences are near ones too.  Rows that repeat doc_id and text count once.
    """
    work = Work(docs.sparkSession, "decontaminate")
    owners = work.save(windows(items, size).withColumn("said", F.array_join("phrase", " ")), "windows")
    phrases = work.save(owners.groupBy("said").agg(F.first("phrase").alias("phrase")).withColumn("wid", F.monotonically_increasing_id()), "phrases")
    owners = work.save(owners.select("said", "item_id").join(phrases.select("said", "wid"), "said").select("wid", "item_id"), "owners")
    df = term_counts(work, docs, _blocks(work, phrases.select(F.explode("phrase").alias("term")).distinct(), "term", WORDS_BLOCK, "terms"))
    rare = work.save(probes(phrases, df, share), "rare")
    index = _index(work, docs, _blocks(work, rare.select("term").distinct(), "term", WORDS_BLOCK, "probe_terms"), size - 1 + slack)
    heads = index.filter("term = ''").select("doc_id", "sha", F.col("words").alias("n_words")).distinct()
    postings = index.filter("term <> ''")
    length, low = F.size("phrase"), F.greatest(F.col("start") - slack, F.lit(0))
    passage = F.slice("around", low - F.col("from") + 1, F.greatest(F.col("start") + length + slack - low, F.lit(0)))
    terms = F.size(F.array_intersect(passage, "phrase"))
    inside = (F.col("start") >= 0) & (F.col("start") + length <= F.col("words"))
    same = inside & (F.slice("around", F.greatest(F.col("start") - F.col("from") + 1, F.lit(1)), length) == F.col("phrase"))

    def met(part: DataFrame, k: int) -> DataFrame:
        got = postings.join(F.broadcast(part), "term").withColumn("start", F.col("at") - F.col("off")).withColumn("terms", terms).filter(F.col("terms") >= F.col("need"))
        return got.select("doc_id", "sha", "wid", "start", "terms", "rank", "lists", length.alias("length"), same.alias("same"))

    hits = work.save(_one_by_one(work, _blocks(work, rare, "wid", block, "probes"), met, "hits_"), "hits")
    near = work.save(hits.groupBy("doc_id", "sha", "wid").agg(F.max("terms").alias("terms")), "near")
    # The shifted lists' intersection; words were compared at each posting.
    found = hits.filter("same").groupBy("doc_id", "sha", "wid", "start", "length", "lists").agg(F.count_distinct("rank").alias("seen"))
    found = work.save(found.filter(F.col("seen") == F.col("lists")).select("doc_id", "sha", "wid", "start", "length"), "found")
    return heads, found, near, owners


def proximity(docs: DataFrame, items: DataFrame, size: int = WINDOW, share: float = SHARE, slack: int = SLACK) -> DataFrame:
    """doc_id, sha, item_id, terms: items of which a window is near some passage, exact matches among them, and the most of a window's terms there.

    Null and wordless texts have none; rows that repeat doc_id and text are reported once.
    """
    _, _, near, owners = matches(docs, items, size, share, slack)
    return near.join(owners, "wid").groupBy("doc_id", "sha", "item_id").agg(F.max("terms").alias("terms"))


def _items(rows: DataFrame, owners: DataFrame, name: str) -> DataFrame:
    """doc_id, sha and the sorted item_ids, as strings, of the windows in rows."""
    named = rows.select("doc_id", "sha", "wid").distinct().join(owners, "wid")
    return named.groupBy("doc_id", "sha").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias(name))


def verdicts(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per distinct (doc_id, text): doc_id, sha, n_words, n_hit, n_items, items_sha256, contaminated, and
    n_near, near_sha256: the items with proximity matches, exact ones among them."""
    heads, found, near, owners = matches(docs, items, size)
    # Union of the matches' intervals, as they come by position.
    at = found.groupBy("doc_id", "sha", "start").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    before = F.max("end").over(Window.partitionBy("doc_id", "sha").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))), F.lit(0))
    hit = at.withColumn("new", new).groupBy("doc_id", "sha").agg(F.sum("new").alias("n_hit"))
    out = _outer(_outer(_outer(heads, hit), _items(found, owners, "ids")), _items(near, owners, "near"))
    n_hit, n_words = F.coalesce("n_hit", F.lit(0)).cast("long"), F.col("n_words").cast("long")
    ids, nears = (F.coalesce(c, F.array().cast("array<string>")) for c in ("ids", "near"))
    return out.select(
        "doc_id", "sha", n_words.alias("n_words"), n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= n_words)).alias("contaminated"), F.size(nears).cast("long").alias("n_near"), F.sha2(F.array_join(nears, ","), 256).alias("near_sha256"),
    )


def _outer(left: DataFrame, right: DataFrame) -> DataFrame:
    right = right.withColumnsRenamed({"doc_id": "rid", "sha": "rsha"})
    return left.join(right, left["doc_id"].eqNullSafe(right["rid"]) & (left["sha"] == right["rsha"]), "left").drop("rid", "rsha")


def contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The verdict of every row of docs, repeated rows included."""
    judged = Work(docs.sparkSession, "verdicts").save(verdicts(docs, items, size), "verdicts")
    return _outer(docs.select(*_key()), judged)


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs, all columns, without contaminated ones."""
    judged = verdicts(docs, items, size)
    return keep_rows(docs, judged.select("doc_id", "sha", (~F.col("contaminated")).alias("keep")))
