"""Spark side of the page operators: the fitted model, main bodies, residue, and what follows from them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import re
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.alike import alike_classes, class_key, pack
from skein.llm.blocks import LISTING, noscript_text, visible_blocks
from skein.llm.pages import BlockModel, cut_labels, describe, fit_blocks
from skein.llm.residue import ALONE_SOURCES, THIN_WORDS, WIDE_SOURCES, has_phrase, judge, masked
from skein.shared import written

#: Sites, and pages of each, in the sample that the block classifier is fitted on.
SAMPLE_SITES, SAMPLE_PAGES = 100, 40
#: Recurring texts up to which their verdicts are broadcast (some 100 bytes each).
BROADCAST_GROUPS = 100_000
#: Ids of pages with a recurring message up to which they are broadcast (8 bytes each).
BROADCAST_IDS = 1_000_000
#: Parts into which a join with a frequent text is split.
SALTS = 16
#: Members of a class of equal bodies that are joined at a time.
MEMBERS_PER_PART = 2_000

_WORDS = re.compile(r"[^\W_]+")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_R = np.uint64(29)


def word_hashes(text: str, cache: dict[str, int]) -> np.ndarray:
    """64-bit hashes of the words (runs of letters and digits, lower case) in order."""
    out = []
    for w in _WORDS.findall(text.lower()):
        h = cache.get(w)
        if h is None:
            if len(cache) > 200_000:
                cache.clear()
            h = cache[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted different hashes of ``size`` consecutive words."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    n = len(words) - size + 1
    h = np.full(n, 0x27D4EB2F165667C5, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            h = (h ^ words[k : k + n]) * _M1
            h ^= h >> _R
            h *= _M2
    return np.unique(h)


def host(url: Column) -> Column:
    """Host of an address, without case; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _pages(responses: DataFrame, html: str, key: str, url: str) -> DataFrame:
    return responses.select(F.col(key).cast("long").alias("id"), host(F.col(url)).alias("site"), F.col(html).alias("h")).where(F.col("h").isNotNull() & F.col("id").isNotNull())


def block_model(responses: DataFrame, *, html: str = "html", key: str = "response_id", url: str = "url", sites: int = SAMPLE_SITES, pages: int = SAMPLE_PAGES) -> BlockModel:
    """Block classifier, fitted on about ``pages`` pages of at most ``sites`` sites.

    Sites are drawn by a hash among those with enough pages for texts to recur,
    pages of a site by a hash of their id, so that large sites do not fill the
    sample.  The fit runs in one task, whose input is bounded by the sample.
    """
    rows = _pages(responses, html, key, url)
    drawn = rows.groupBy("site").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n") < 4, F.xxhash64("site"), "site").limit(sites).withColumn("share", F.lit(1.1 * pages) / F.col("n")).select("site", "share")
    place = F.shiftrightunsigned(F.xxhash64("id"), 11) / float(2**53)
    sample = rows.join(F.broadcast(drawn), "site").where(place < F.col("share")).groupBy("id").agg(F.min(F.struct("site", "h")).alias("p"))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sorted({(i, s, h) for b in batches for i, s, h in zip(*(c.to_pylist() for c in b.columns))})
        m = fit_blocks([(s, h) for _, s, h in known])
        yield pa.RecordBatch.from_arrays([pa.array([*m.weights, ""], pa.string()), pa.array([*m.weights.values(), m.bias], pa.float64())], names=["f", "w"])

    weights = {r["f"]: r["w"] for r in sample.select("id", "p.site", "p.h").limit(2 * sites * pages).repartition(1).mapInArrow(fit, "f string, w double").collect()}
    return BlockModel(weights, weights.pop("", 0.0))


def page_bodies(responses: DataFrame, model: BlockModel, *, html: str = "html", key: str = "response_id", url: str = "url", shingle: int = 0) -> DataFrame:
    """One row per response with html: its body's block md5s, residue and, if asked, shingles.

    ``(id, site, kind string, phrases array<binary>, phrased boolean, context bigint, alone boolean, md5s array<binary>, sets binary, ck bigint)``.
    ``kind`` is the residue that a rule alone decides; ``phrases`` are digests of
    masked texts, of any length, that recurrence over sources decides: those with a
    phrase (``phrased``), or the one text of a body (``alone``).  ``context`` stands
    for the longest other text of the body.  Null html gives no row; empty html gives a row
    without blocks.  ``sets`` holds the sorted hashes of the body's different
    ``shingle``-word sequences, if ``shingle`` (then without md5s), and ``ck`` a
    key of that set.
    """
    shared = responses.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = BlockModel(*shared.value)
        cache: dict[str, int] = {}
        digest = lambda t: hashlib.md5(t.encode("utf-8", "replace"), usedforsecurity=False).digest()
        for batch in batches:
            kinds, phrases, phrased, contexts, alones, md5s, sets, keys = [], [], [], [], [], [], [], []
            for page in batch.column(2).to_pylist():
                blocks = visible_blocks(page)
                places, skels, segments, _ = describe(blocks)
                body = [b for b, keep in zip(blocks, cut_labels(labels, places, skels, segments)) if keep]
                texts = [b.text for b in body]
                # Hardly any content and no headline: what the page shows is a message, if anything.
                bare = sum(t.count(" ") + 1 for t in texts) <= THIN_WORDS and not any(b.chain and b.chain[-1][1] == "h1" for b in body)
                seen = [b.text for b in (blocks if bare else body) if not any(e[1] in LISTING for e in b.chain)]
                kind, found = judge(seen, bare)
                if not body and kind is None and any(has_phrase(t.lower()) for t in noscript_text(page)):
                    kind = "message"
                alone = not kind and len(set(texts)) == 1 and texts[0] in seen
                around = max((t for t in texts if not found or masked(t) not in found), key=len, default="") if found else ""
                kinds.append(kind)
                phrases.append([digest(m) for m in found or ([masked(texts[0])] if alone else [])])
                phrased.append(bool(found))
                contexts.append(xxhash.xxh3_64_intdigest(around) - 2**63)
                alones.append(alone)
                md5s.append([digest(t) for t in dict.fromkeys(texts)] if not kind and not shingle else [])
                packed = pack(shingles(word_hashes(" ".join(texts), cache), shingle)) if shingle and not kind else None
                sets.append(packed)
                keys.append(class_key(packed) if packed else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(kinds, pa.string()), pa.array(phrases, pa.list_(pa.binary())), pa.array(phrased, pa.bool_()), pa.array(contexts, pa.int64()), pa.array(alones, pa.bool_()), pa.array(md5s, pa.list_(pa.binary())), pa.array(sets, pa.binary()), pa.array(keys, pa.int64())],
                names=["id", "site", "kind", "phrases", "phrased", "context", "alone", "md5s", "sets", "ck"],
            )

    rows = _pages(responses, html, key, url)
    cores = responses.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() * 2 <= cores:  # one small file: parsing is worth more than the exchange
        rows = rows.repartition(cores)
    schema = "id bigint, site string, kind string, phrases array<binary>, phrased boolean, context bigint, alone boolean, md5s array<binary>, sets binary, ck bigint"
    return rows.mapInArrow(run, schema)


def _recurring(bodies: DataFrame) -> DataFrame:
    """Ids with a text that recurs on many sources as messages do."""
    held = bodies.where(F.col("kind").isNull() & (F.size("phrases") > 0)).select("id", "site", "context", "alone", "phrased", F.explode("phrases").alias("m"))
    by = ["m", "alone", "phrased"]
    wide = F.when(F.col("phrased"), (F.col("sources") >= WIDE_SOURCES) & (F.col("alone") | (F.col("contexts") >= WIDE_SOURCES))).otherwise(F.col("sources") >= ALONE_SOURCES)
    groups = held.groupBy(*by).agg(F.count_distinct("site").alias("sources"), F.count_distinct("context").alias("contexts")).where(wide).select(*by)
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")
    if groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        return held.join(F.broadcast(groups), by, "left_semi").select("id").distinct()
    split = groups.select(*by, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).cast("bigint").alias("salt"))
    return held.withColumn("salt", salt).join(split, [*by, "salt"], "left_semi").select("id").distinct()


def residue_pages(responses: DataFrame, **names: str) -> DataFrame:
    """Responses whose main body is or holds residue: distinct ``(response_id)``.

    Rows without html are no cases; a page without any body text is one only if
    it shows a message, or carries a notice in noscript that scripts are
    required.  Repeated rows count once.
    """
    found = page_bodies(responses, block_model(responses, **names), **names).select("id", "site", "kind", "phrases", "phrased", "context", "alone")
    bodies = written(found.where(F.col("kind").isNotNull() | (F.size("phrases") > 0)), "residue")
    return bodies.where(F.col("kind").isNotNull()).select("id").unionByName(_recurring(bodies)).distinct().withColumnRenamed("id", "response_id")


def clean_bodies(responses: DataFrame, *, shingle: int = 0, **names: str) -> DataFrame:
    """Bodies (see :func:`page_bodies`) of the responses that are no residue, written once."""
    bodies = written(page_bodies(responses, block_model(responses, **names), shingle=shingle, **names).withColumn("no", F.monotonically_increasing_id()), "bodies")
    messages = written(_recurring(bodies), "messages")
    few = messages.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return bodies.where(F.col("kind").isNull()).join(F.broadcast(messages) if few else messages, "id", "left_anti")


def body_blocks(responses: DataFrame, **names: str) -> DataFrame:
    """Different blocks of each main body: distinct ``(response_id, block_md5)``.

    Responses that :func:`residue_pages` lists have no rows, nor have pages
    without a body.  Repeated rows count once; should two rows of one id differ,
    the blocks of both come out.
    """
    found = clean_bodies(responses, **names).select(F.col("id").alias("response_id"), F.explode("md5s").alias("m")).distinct()
    return found.select("response_id", F.lower(F.hex("m")).alias("block_md5"))


def _members(responses: DataFrame, shingle: int, **names: str) -> tuple[DataFrame, DataFrame]:
    bodies = clean_bodies(responses, shingle=shingle, **names).where(F.col("ck").isNotNull())
    return bodies.select("no", "ck", "sets"), bodies.select("id", "ck").distinct()


def _salted(members: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with the part of their class that they belong to, and ``(ck, part)`` of each class."""
    split = classes.select("ck", F.floor(F.col("n_members") / MEMBERS_PER_PART).cast("int").alias("last"))
    hot = split.where("last > 0")
    few = hot.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    placed = members.join(F.broadcast(hot) if few else hot, "ck", "left").select("id", "ck", F.pmod(F.xxhash64("id"), F.coalesce("last", F.lit(0)) + 1).cast("int").alias("part"))
    return placed, split.select("ck", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("part"))


def alike_pages(responses: DataFrame, *, threshold: float = 0.5, shingle: int = 3, **names: str) -> DataFrame:
    """Pairs of responses with alike bodies: distinct ``(response_id_a, response_id_b)``, smaller first.

    Alike: of the different ``shingle``-word sequences of either body at least
    ``threshold`` occur in both.  Residue takes no part, nor do bodies of fewer
    words than a shingle.  Members of one class (equal sets) are alike; the
    definition asks for every pair, so that a class of k members gives
    k(k-1)/2 rows, made in parts of ``MEMBERS_PER_PART`` members.  Use
    :func:`alike_page_classes` for one row per response.
    """
    docs, members = _members(responses, shingle, **names)
    classes = members.groupBy("ck").agg(F.count(F.lit(1)).alias("n_members"))
    placed, parts = _salted(members, classes)
    several = parts.join(classes.where("n_members > 1").select("ck"), "ck", "left_semi")
    pairs = alike_classes(docs, threshold).distinct().unionByName(several.select(F.col("ck").alias("a"), F.col("ck").alias("b")).distinct())
    side = lambda x, c: placed.select(F.col("id").alias(x), F.col("ck").alias(c), F.col("part").alias(f"p{c}"))
    at = lambda c: parts.select(F.col("ck").alias(c), F.col("part").alias(f"p{c}"))
    found = pairs.join(at("a"), "a").join(side("x", "a"), ["a", "pa"]).join(at("b"), "b").join(side("y", "b"), ["b", "pb"])
    found = found.where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    return found.select(F.least("x", "y").alias("response_id_a"), F.greatest("x", "y").alias("response_id_b")).where("response_id_a < response_id_b").distinct()


def alike_page_classes(responses: DataFrame, *, threshold: float = 0.5, shingle: int = 3, **names: str) -> DataFrame:
    """One row per response: class id (smallest member), members, and links of its class to other classes."""
    docs, members = _members(responses, shingle, **names)
    links = alike_classes(docs, threshold)
    degree = links.select(F.explode(F.array("a", "b")).alias("ck")).groupBy("ck").agg(F.count(F.lit(1)).alias("n_links"))
    classes = members.groupBy("ck").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n_members"))
    placed, parts = _salted(members, classes)
    named = parts.join(classes.join(degree, "ck", "left"), "ck")
    return placed.join(named, ["ck", "part"]).select(F.col("id").alias("response_id"), "class_id", "n_members", F.coalesce("n_links", F.lit(0)).alias("n_links"))
