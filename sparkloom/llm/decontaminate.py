"""Benchmark decontamination by spaced seeds, with DataFrame expressions only.

Fixed masks pick five tokens out of a short span and ignore the others, so a seed
still agrees when an ignored token was replaced. Hashes of the test items' seeds are
joined with the hashes at every position of every training text; each agreement is
verified around the seed, inside the item and the text: all windows of ``MIN_WINDOW`` aligned tokens
that hold the seed (the whole item where it is shorter) and the window that reaches ``REACH`` tokens
beyond the seed on both sides are compared token by token, and the agreement counts when at least
``MIN_SHARE`` of the tokens of the best window are equal.

Items of fewer than five tokens have no spaced seed; with ``short`` they are found as whole runs of
their tokens. ``drop_contaminated`` leaves them out unless told otherwise: a text that holds an
answer like "yes" is not contaminated.

Edge cases: null or empty texts have no tokens and match nothing; a null doc_id or item_id is a
value like any other. Texts are known by id and text, so several rows of one id are all searched
and their agreements added up in one result row for each (doc_id, item_id); repeated rows count
once. Ties cannot occur. Empty tables give an empty result. Only the id and text columns are
read, so further columns cannot clash, and ``drop_contaminated`` passes them through under any
name. A very long text is searched by one task, which holds its tokens and one hash a mask and
position.

The seeds are broadcast only up to ``max_broadcast`` rows, counted first; beyond that seeds and
positions are joined by shuffle, without the texts, and the places of a pair of a text and an item are
gathered by stretches of ``STRETCH`` positions. The pairs are written; only the texts in them are
shuffled to meet them, as long as there are at most ``max_broadcast`` of these, whose ids are
broadcast for that; beyond, all texts are. All ways give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import column, cut, unused

MASKS = ("11111", "1101011", "110010011")
#: For items of one to four tokens: all of them.
SHORT = ("1", "11", "111", "1111")
MIN_WINDOW = 13
REACH = 6
MIN_SHARE = 0.8
MAX_BROADCAST = 500_000
#: Positions of a text whose agreements with an item travel in one row.
STRETCH = 1024

NOT_TOKEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_TOKEN), "")


def _seed_array(mask: str, words: str) -> str:
    picked = ", ".join(f"{words}[i + {k}]" for k, x in enumerate(mask) if x == "1")
    return f"CASE WHEN size({words}) >= {len(mask)} THEN transform(sequence(0, size({words}) - {len(mask)}), i -> xxhash64('{mask}', {picked})) ELSE array() END"


def _positions(df: DataFrame, masks: tuple[str, ...], words: str, hash_: str, pos: str, span: str, keep: list[str]) -> DataFrame:
    """One row for each mask and position: the seed's hash, its start and the mask's span."""
    lens = [f"greatest(0, size({words}) - {len(m) - 1})" for m in masks]
    seeds = df.select(*keep, words, F.expr("concat(" + ", ".join(_seed_array(m, words) for m in masks) + ")").alias("_h"))
    # outer: an inner explode infers a filter that inlines the token split into every lambda
    rows = seeds.select(*keep, words, F.posexplode_outer("_h").alias("_p", hash_))
    where, wide, before = "CASE", "CASE", "0"
    for k, m in enumerate(masks):
        upto = f"{before} + {lens[k]}"
        where += f" WHEN _p < {upto} THEN _p - ({before})"
        wide += f" WHEN _p < {upto} THEN {len(m)}"
        before = upto
    return rows.select(*keep, words, hash_, F.expr(f"{where} END").alias(pos), F.expr(f"{wide} END").alias(span))


def _verified(hits: DataFrame) -> DataFrame:
    """The agreements that hold, with their share, from rows with dw, dp (text) and iw, ip, span (item)."""
    width = F.expr(f"least({MIN_WINDOW}, size(iw))")
    near = {"lo0": F.expr(f"greatest(-{REACH}, -ip, -dp)"), "hi0": F.expr(f"least(span + {REACH}, size(iw) - ip, size(dw) - dp)")}
    win = hits.withColumn("wide", width).withColumns(near | {"lo": F.expr("greatest(span - wide, -ip, -dp)"), "hi": F.expr("least(wide, size(iw) - ip, size(dw) - dp)")})
    # guarded, as Spark may evaluate the conditions of a join in any order
    win = win.withColumn("eq", F.expr("CASE WHEN hi - lo >= wide THEN transform(sequence(lo, hi - 1), o -> CAST(get(dw, dp + o) = get(iw, ip + o) AS INT)) END"))
    best = F.expr("CASE WHEN size(eq) >= wide THEN array_max(transform(sequence(0, size(eq) - wide), s -> aggregate(slice(eq, s + 1, wide), 0, (a, x) -> a + x))) END")
    around = F.expr("CASE WHEN hi0 - lo0 >= wide THEN aggregate(sequence(lo0, hi0 - 1), 0, (a, o) -> a + CAST(get(dw, dp + o) = get(iw, ip + o) AS INT)) / (hi0 - lo0) END")
    return win.withColumn("share", F.greatest(best / F.col("wide"), around)).filter(F.col("share") >= MIN_SHARE)


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", max_broadcast: int = MAX_BROADCAST, short: bool = True) -> DataFrame:
    """One row (doc_id, item_id, n_windows, best_share) for each pair with a verified overlap."""
    found = _found(docs, items, doc_id, text, item_id, item_text, max_broadcast, short)
    return found.groupBy("doc_id", "item_id").agg(F.countDistinct("dk", "ik", "dp", "ip", "span").alias("n_windows"), F.max("share").alias("best_share"))


def _found(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, max_broadcast: int, short: bool) -> DataFrame:
    """The verified places: (doc_id, item_id, dk, ik, dp, ip, span, share), dk the text's hash."""
    it = items.select(column(item_id).alias("item_id"), tokens(column(item_text)).alias("iw")).filter(F.size("iw") >= (1 if short else 5)).distinct()
    it = it.select("item_id", "iw", F.xxhash64("iw").alias("ik"))
    # at most four lengths: the positions of short items are hashed only where there are any
    lengths = {r[0] for r in it.filter(F.size("iw") < 5).select(F.size("iw")).distinct().collect()}
    masks = MASKS + tuple(m for m in SHORT if len(m) in lengths)
    seeds = _positions(it, masks, "iw", "h", "ip", "span", ["item_id", "ik"]).filter("h IS NOT NULL AND (span >= 5 OR span = size(iw))")
    seeds = seeds.select("h", "item_id", "ik", "ip", "span")
    dt = docs.select(column(doc_id).alias("doc_id"), F.xxhash64(column(text)).alias("dk"), tokens(column(text)).alias("dw"))
    at = _positions(dt, masks, "dw", "dh", "dp", "dspan", ["doc_id", "dk"])
    same_item = F.col("hit").eqNullSafe(F.col("item_id")) & (F.col("hk") == F.col("ik"))
    if seeds.select(F.lit(1)).limit(max_broadcast + 1).count() <= max_broadcast:
        met = at.join(F.broadcast(seeds.withColumnsRenamed({"item_id": "hit", "ik": "hk"})), F.col("dh") == F.col("h"))
        hits = met.select("doc_id", "dk", "dw", "dp", "hit", "hk", "ip", "span").join(F.broadcast(it), same_item)
    else:
        met = at.select("doc_id", "dk", "dh", "dp").join(seeds, F.col("dh") == F.col("h"))
        stretch = F.floor(F.col("dp") / STRETCH).alias("stretch")
        pairs = met.groupBy(F.col("doc_id").alias("hit_doc"), F.col("dk").alias("hit_dk"), F.col("item_id").alias("hit"), F.col("ik").alias("hk"), stretch)
        pairs = cut(pairs.agg(F.collect_set(F.struct("dp", "ip", "span")).alias("places")))
        same_text = F.col("hit_doc").eqNullSafe(F.col("doc_id")) & (F.col("hit_dk") == F.col("dk"))
        ids = pairs.select("hit_doc", "hit_dk").distinct()
        if ids.limit(max_broadcast + 1).count() <= max_broadcast:
            dt = dt.join(F.broadcast(ids), same_text, "left_semi")
        hits = pairs.join(it, same_item).join(dt.dropDuplicates(["doc_id", "dk"]), same_text)
        hits = hits.select("doc_id", "item_id", "dk", "ik", "dw", "iw", F.explode("places").alias("p")).select("doc_id", "item_id", "dk", "ik", "dw", "iw", "p.*")
    return _verified(hits).select("doc_id", "item_id", "dk", "ik", "dp", "ip", "span", "share")


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", max_broadcast: int = MAX_BROADCAST, short: bool = False) -> DataFrame:
    """The rows of ``docs`` whose text has no verified overlap; each is judged by its id and text, so rows that
    share an id (or have none) stay unless their own text overlaps."""
    name, key, own = (unused(docs, x) for x in ("bad", "bad_key", "own_key"))
    bad = _found(docs, items, doc_id, text, item_id, item_text, max_broadcast, short).select(F.col("doc_id").alias(name), F.col("dk").alias(key)).distinct()
    keyed = docs.withColumn(own, F.xxhash64(column(text)))
    return keyed.join(bad, (F.col(own) == F.col(key)) & column(doc_id).eqNullSafe(F.col(name)), "left_anti").drop(own)


def oracle() -> str:
    """The same pairs as DuckDB SQL."""
    toks = r"regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

    def seeds(words: str, ids: str, source: str, whole: bool) -> str:
        parts = []
        for m in MASKS + SHORT:
            key = ", ".join(f"{words}[p + {j + 1}]" for j, x in enumerate(m) if x == "1")
            only = f" WHERE len({words}) = {len(m)}" if whole and m in SHORT else ""
            # texts are searched for runs of a length only if an item has it
            some = f" WHERE EXISTS (SELECT 1 FROM its WHERE len(iw) = {len(m)})" if not whole and m in SHORT else ""
            parts.append(f"SELECT {ids}, p, {len(m)} AS span, concat_ws(' ', '{m}', {key}) AS h FROM (SELECT {ids}, {words}, unnest(range(0, len({words}) - {len(m) - 1})) AS p FROM {source}{only}{some})")
        return " UNION ALL ".join(parts)

    return f"""
WITH dt AS (SELECT row_number() OVER () AS r, doc_id, dw FROM (SELECT doc_id, {toks} AS dw FROM (SELECT DISTINCT doc_id, text FROM documents))),
its AS (SELECT row_number() OVER () AS ir, item_id, iw FROM (SELECT DISTINCT item_id, {toks} AS iw FROM benchmark) WHERE len(iw) >= 1),
ds AS ({seeds('dw', 'r', 'dt', False)}),
bs AS ({seeds('iw', 'ir', 'its', True)}),
hits AS (SELECT DISTINCT ds.r, bs.ir, ds.p AS dp, bs.p AS ip, bs.span FROM ds JOIN bs USING (h)),
win AS (SELECT doc_id, item_id, r, ir, dw, iw, dp, ip, span, least({MIN_WINDOW}, len(iw)) AS wide FROM hits JOIN dt USING (r) JOIN its USING (ir)),
sp AS (SELECT *, greatest(span - wide, -ip, -dp) AS lo, least(wide, len(iw) - ip, len(dw) - dp) AS hi, greatest(-{REACH}, -ip, -dp) AS lo0, least(span + {REACH}, len(iw) - ip, len(dw) - dp) AS hi0 FROM win),
st AS (SELECT * EXCLUDE (lo, hi, lo0, hi0), unnest(range(lo, hi - wide + 1)) AS s, wide AS n FROM sp WHERE hi - lo >= wide UNION ALL SELECT * EXCLUDE (lo, hi, lo0, hi0), lo0, hi0 - lo0 FROM sp WHERE hi0 - lo0 >= wide),
ok AS (SELECT doc_id, item_id, r, ir, dp, ip, span, len(list_filter(range(s, s + n), lambda o: dw[dp + o + 1] = iw[ip + o + 1])) / n AS share FROM st)
SELECT doc_id, item_id, CAST(count(DISTINCT (r, ir, dp, ip, span)) AS BIGINT) AS n_windows, max(share) AS best_share
FROM ok WHERE share >= {MIN_SHARE} GROUP BY doc_id, item_id"""
