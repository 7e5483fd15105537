"""Dictionaries learned from true pairs, or without labels from differences in use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import jaro_winkler_udf
from ..functions.text import has_non_latin
from ..sources.scratch import written

LEAST, SHARE, GENERIC = 25, 0.10, 600


def _count(t: Column, x: Column) -> Column:
    return F.size(F.filter(t, lambda y: y == x))


def residue(a: Column, b: Column) -> Column:
    """a without the tokens that b has, as often as b has them; first occurrences go first."""
    nth = F.transform(a, lambda x, i: F.struct(x.alias("x"), _count(F.slice(a, F.lit(1), i + 1), x).alias("nth")))
    return F.transform(F.filter(nth, lambda e: e["nth"] > _count(b, e["x"])), lambda e: e["x"])


def align(pairs: DataFrame) -> DataFrame:
    """pairs (country, field, clean, noisy: token arrays) with rc and rn, the residues, and links: array<struct<noisy, clean>>.

    Residues of one length are linked place by place; one noisy token against two clean ones is a
    phrase.  Others say only which tokens one side leaves out.
    """
    rows = pairs.withColumns({"rc": residue(F.col("clean"), F.col("noisy")), "rn": residue(F.col("noisy"), F.col("clean"))})
    link = lambda n, c: F.struct(n.alias("noisy"), c.alias("clean"))
    none = F.array().cast("array<struct<noisy:string,clean:string>>")
    links = F.when(F.size("rc") == F.size("rn"), F.zip_with("rn", "rc", link)).when((F.size("rn") == 1) & (F.size("rc") == 2), F.array(link(F.col("rn")[0], F.array_join("rc", " ")))).otherwise(none)
    return rows.withColumn("links", links)


def collect(aligned: DataFrame) -> dict[str, DataFrame]:
    """Counts per country and field: pair (noisy, clean, n), and (token, n) of noisy, clean, generic and lead.

    Pairs with an empty side don't count; generic counts residues that have no link.
    """
    rows = aligned.filter((F.size("clean") > 0) & (F.size("noisy") > 0))
    by = lambda col: rows.select("country", "field", F.explode(col).alias("token")).groupBy("country", "field", "token").agg(F.count(F.lit(1)).alias("n"))
    loose = F.when(F.size("links") == 0, F.concat("rc", "rn")).otherwise(F.array().cast("array<string>"))
    pair = rows.select("country", "field", F.explode("links").alias("x")).groupBy("country", "field", F.col("x.noisy").alias("noisy"), F.col("x.clean").alias("clean")).agg(F.count(F.lit(1)).alias("n"))
    return {"pair": pair, "noisy": by(F.array_distinct("noisy")), "clean": by(F.array_distinct("clean")), "generic": by(loose), "lead": by(F.slice("noisy", 1, 1))}


def is_subsequence(short: Column, long: Column) -> Column:
    """Whether short, strictly shorter, is long with letters left out."""
    step = lambda acc, c: F.when((acc < F.length(short)) & (F.substring(short, acc + 1, F.lit(1)) == c), acc + 1).otherwise(acc)
    return (F.length(short) < F.length(long)) & (F.aggregate(F.split(long, ""), F.lit(0), step) == F.length(short))


def acronym(key: Column, phrase: Column) -> Column:
    return key == F.array_join(F.transform(F.split(phrase, " "), lambda w: F.substring(w, 1, 1)), "")


def distil(c: dict[str, DataFrame]) -> DataFrame:
    """The lexicon (country, field, kind, key, value, weight) of collect's counts.

    An edge needs LEAST occurrences and SHARE of the noisy token's.  A token in another script
    that stands for a Latin one is a translit; a shortened or similar one a variant, of the most frequent clean
    member of its connected component; a token for two is an expand, unless it is
    one of the others.
    """
    from .components import components

    noisy = c["noisy"].select("country", "field", F.col("token").alias("noisy"), F.col("n").alias("total"))
    edges = c["pair"].join(noisy, ["country", "field", "noisy"]).filter((F.col("n") >= LEAST) & (F.col("n") >= SHARE * F.col("total")) & (F.col("noisy") != F.col("clean")))
    phrase, foreign = F.col("clean").contains(" "), has_non_latin(F.col("noisy"))
    best = F.row_number().over(Window.partitionBy("country", "field", "noisy").orderBy(F.desc("n"), "clean"))
    one = edges.filter(~phrase & foreign & ~has_non_latin(F.col("clean"))).withColumn("rn", best).filter("rn = 1")
    translit = one.select("country", "field", F.lit("translit").alias("kind"), F.col("noisy").alias("key"), F.col("clean").alias("value"), F.col("n").cast("double").alias("weight"))
    near = edges.filter(~phrase & ~foreign).filter(is_subsequence(F.col("noisy"), F.col("clean")) | is_subsequence(F.col("clean"), F.col("noisy")) | (jaro_winkler_udf("noisy", "clean") >= 0.87))
    tag = lambda t: F.concat_ws("\t", "country", "field", t)
    comp = components(near.select(tag("noisy").alias("a"), tag("clean").alias("b")))
    said = c["clean"].select(tag("token").alias("node"), F.col("n").alias("clean_n"))
    members = comp.join(said, "node", "left").withColumn("token", F.split("node", "\t")[2])
    rank = F.struct(F.coalesce("clean_n", F.lit(0)).alias("n"), (-F.length("token")).alias("l"), F.col("token"))
    top = members.groupBy("root").agg(F.max_by("token", rank).alias("value"))
    variant = members.join(top, "root").filter("token <> value").select(F.split("node", "\t")[0].alias("country"), F.split("node", "\t")[1].alias("field"), F.lit("variant").alias("kind"), F.col("token").alias("key"), "value", F.coalesce("clean_n", F.lit(0)).cast("double").alias("weight"))
    known = translit.unionByName(variant).select("country", "field", F.col("key").alias("noisy"))
    words = edges.filter(phrase & (foreign | F.col("clean").startswith(F.col("noisy")) | acronym(F.col("noisy"), F.col("clean")))).join(known, ["country", "field", "noisy"], "left_anti")
    expand = words.withColumn("rn", best).filter("rn = 1").select("country", "field", F.lit("expand").alias("kind"), F.col("noisy").alias("key"), F.col("clean").alias("value"), F.col("n").cast("double").alias("weight"))
    first = F.row_number().over(Window.partitionBy("country", "field").orderBy(F.desc("n"), "token"))
    generic = c["generic"].withColumn("rn", first).filter(F.col("rn") <= GENERIC).select("country", "field", F.lit("generic").alias("kind"), F.col("token").alias("key"), F.lit("").alias("value"), F.col("n").cast("double").alias("weight"))
    prefix = junk_prefix(c["lead"], c["clean"]).select("country", "field", F.lit("prefix").alias("kind"), F.col("token").alias("key"), F.lit("").alias("value"), F.col("n").cast("double").alias("weight"))
    out = translit
    for x in (variant, expand, generic, prefix):
        out = out.unionByName(x)
    return out


def junk_prefix(lead: DataFrame, clean: DataFrame) -> DataFrame:
    """country, field, token, n: Latin tokens that lead noisy texts LEAST times and are ten times rarer in clean ones."""
    own = clean.select("country", "field", "token", F.col("n").alias("m"))
    rows = lead.join(own, ["country", "field", "token"], "left").withColumn("m", F.coalesce("m", F.lit(0)))
    return rows.filter((F.col("n") >= LEAST) & (F.col("m") < 0.1 * F.col("n")) & ~has_non_latin(F.col("token"))).select("country", "field", "token", "n")


#: Label-free learning: the least share of a country's tokens, over-use on the noisy and the clean side, neighbours' cosine, and
#: the ratio of frequencies that makes a token generic.
MIN_SHARE, OVER_NOISY, OVER_CLEAN, CONTEXT_COSINE, GENERIC_RATIO = 2e-4, 3.0, 1.15, 0.9, 2.0


def _usage(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(country, token, n, p) and (country, token, side, neighbour, n) of (country, doc, text); ^ and $ are a text's ends."""
    t = F.filter(F.split("text", " "), lambda x: x != "")
    rows = docs.select("country", t.alias("t"))
    at = lambda i: F.get("t", i)
    each = F.transform("t", lambda x, i: F.struct(x.alias("token"), F.coalesce(at(i - 1), F.lit("^")).alias("l"), F.coalesce(at(i + 1), F.lit("$")).alias("r")))
    rows = rows.select("country", F.explode(each).alias("x")).select("country", "x.*")
    n = rows.groupBy("country", "token").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("country").agg(F.sum("n").alias("total"))
    side = lambda k: F.struct(F.lit(k).alias("side"), F.col(k).alias("neighbour"))
    near = rows.select("country", "token", F.explode(F.array(side("l"), side("r"))).alias("x")).select("country", "token", "x.*")
    used = n.join(F.broadcast(total), "country").withColumn("p", F.col("n") / F.col("total")).drop("total")
    return used, near.groupBy("country", "token", "side", "neighbour").agg(F.count(F.lit(1)).alias("n"))


def _both(clean: DataFrame, noisy: DataFrame) -> DataFrame:
    """country, token, nc, pc, nn, pn: use on either side, 0 where it has none; numbers left out."""
    a = clean.select("country", "token", F.col("n").alias("nc"), F.col("p").alias("pc"))
    b = noisy.select("country", "token", F.col("n").alias("nn"), F.col("p").alias("pn"))
    return a.join(b, ["country", "token"], "full").na.fill(0).filter(~F.col("token").rlike(r"^[0-9]+$"))


def label_free_variants(clean: DataFrame, noisy: DataFrame) -> DataFrame:
    """country, key, value, cos of texts (country, doc, text): tokens over-used in noisy ones that shorten a token over-used in clean ones, with the
    same first letter, and stand among the same neighbours; of several, by cosine and then the last in order."""
    (n1, c1), (n2, c2) = _usage(clean), _usage(noisy)
    both = written(_both(n1, n2), "use")
    short = both.filter((F.col("pn") > MIN_SHARE) & (F.col("pn") > OVER_NOISY * F.col("pc"))).select("country", F.col("token").alias("key"))
    long = both.filter((F.col("pc") > MIN_SHARE) & (F.col("pc") > OVER_CLEAN * F.col("pn"))).select("country", F.col("token").alias("value"))
    # A token with a share of MIN_SHARE is one of 5,000 of a country at most, so that these joins have a bound.
    near = short.withColumn("f", F.substring("key", 1, 1)).join(long.withColumn("f", F.substring("value", 1, 1)), ["country", "f"]).filter(is_subsequence(F.col("key"), F.col("value"))).drop("f")
    length = lambda c, k: c.groupBy("country", F.col("token").alias(k)).agg(F.sqrt(F.sum(F.col("n") * F.col("n").cast("double"))).alias(f"len_{k}"))
    key = c2.select("country", F.col("token").alias("key"), "side", "neighbour", F.col("n").alias("a"))
    value = c1.select("country", F.col("token").alias("value"), "side", "neighbour", F.col("n").alias("b"))
    dots = near.join(key, ["country", "key"]).join(value, ["country", "value", "side", "neighbour"]).groupBy("country", "key", "value").agg(F.sum(F.col("a") * F.col("b").cast("double")).alias("dot"))
    rows = dots.join(length(c2, "key"), ["country", "key"]).join(length(c1, "value"), ["country", "value"]).withColumn("cos", F.round(F.col("dot") / (F.col("len_key") * F.col("len_value")), 6))
    rank = F.row_number().over(Window.partitionBy("country", "key").orderBy(F.desc("cos"), F.desc("value")))
    return rows.withColumn("rn", rank).filter(F.col("rn") == 1).filter(F.col("cos") >= CONTEXT_COSINE).select("country", "key", "value", "cos")


def label_free_generic(clean: DataFrame, noisy: DataFrame, variants: DataFrame) -> DataFrame:
    """country, token, gap: tokens whose shares on the two sides differ by GENERIC_RATIO and more, neither key nor value of a variant; the GENERIC widest gaps."""
    both = _both(_usage(clean)[0], _usage(noisy)[0])
    most, least = F.greatest("pc", "pn"), F.least("pc", "pn")
    mapped = variants.select("country", F.explode(F.array("key", "value")).alias("token")).distinct()
    rows = both.filter((most > MIN_SHARE) & (most > GENERIC_RATIO * least)).join(mapped, ["country", "token"], "left_anti").withColumn("gap", F.round(F.abs(F.col("pc") - F.col("pn")), 9))
    rank = F.row_number().over(Window.partitionBy("country").orderBy(F.desc("gap"), "token"))
    return rows.withColumn("rn", rank).filter(F.col("rn") <= GENERIC).select("country", "token", "gap")


def label_free_prefix(clean: DataFrame, noisy: DataFrame) -> DataFrame:
    """country, token, n: junk_prefix of unpaired texts; clean counts are of texts, scaled to the noisy side's number of them."""
    t = F.filter(F.split("text", " "), lambda x: x != "")
    n = clean.groupBy("country").agg(F.count(F.lit(1)).alias("nc")).join(noisy.groupBy("country").agg(F.count(F.lit(1)).alias("nn")), "country")
    lead = noisy.select("country", F.get(t, F.lit(0)).alias("token")).filter("token is not null").groupBy("country", "token").agg(F.count(F.lit(1)).alias("n"))
    said = clean.select("country", F.explode(F.array_distinct(t)).alias("token")).groupBy("country", "token").agg(F.count(F.lit(1)).alias("m")).join(F.broadcast(n), "country")
    field = lambda r: r.withColumn("field", F.lit(""))
    return junk_prefix(field(lead), field(said.select("country", "token", (F.col("m") * F.col("nn") / F.col("nc")).alias("n")))).drop("field")


def induce(clean: DataFrame, noisy: DataFrame, field: str, prefixes: bool = True) -> DataFrame:
    """The lexicon of countries without labels, of texts (country, doc, text) of one field."""
    clean, noisy = written(clean, "clean"), written(noisy, "noisy")
    variants = written(label_free_variants(clean, noisy), "variants")
    row = lambda rows, kind, key, value, weight: rows.select("country", F.lit(field).alias("field"), F.lit(kind).alias("kind"), F.col(key).alias("key"), value.alias("value"), weight.cast("double").alias("weight"))
    out = row(variants, "variant", "key", F.col("value"), F.col("cos")).unionByName(row(label_free_generic(clean, noisy, variants), "generic", "token", F.lit(""), F.col("gap")))
    return out.unionByName(row(label_free_prefix(clean, noisy), "prefix", "token", F.lit(""), F.col("n"))) if prefixes else out


def unlabelled(countries: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Countries that the lexicon doesn't have."""
    return countries.select("country").distinct().join(lexicon.select("country").distinct(), "country", "left_anti")


def upsert(lexicon: DataFrame, new: DataFrame) -> DataFrame:
    """lexicon with the countries of new replaced."""
    return lexicon.join(new.select("country").distinct(), "country", "left_anti").unionByName(new)
