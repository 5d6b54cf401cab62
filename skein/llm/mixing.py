"""Mixing sources to target weights by a low-discrepancy schedule.

Method: van der Corput points, mapped through the cumulative weights of the
sources, give a sequence of slots in which every source is spread as evenly as
its weight allows.  Slots are ranked per source and joined to blocks of equal
token counts, cut from each source's documents in shuffled order; a source that
has to repeat is shuffled anew for every pass.

Ranks and running sums are taken within bounded buckets, with offsets per
bucket, so that no source has to pass through one task.
"""

from __future__ import annotations

import base64
import importlib.util
import itertools
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.shared import parts_for, written

#: Documents (or slots) that one bucket should hold.
PER_BUCKET = 50_000
#: Tokens of a block.
BLOCK_TOKENS = 16_384
#: Passes over sources up to which the list of them is broadcast.
BROADCAST_USES = 100_000


def tokenizer_folder() -> str | None:
    """Folder of the installed public tokenizer files, or None."""
    spec = importlib.util.find_spec("public_tokenizers")
    return str(Path(spec.origin).parent) if spec and spec.origin else None


def _vocabulary(path: str | None) -> tuple[bytes, str]:
    """The ranks file and the splitting pattern of the tokenizer, read on the driver and shipped with the job."""
    path = path or os.environ.get("SKEIN_VOCABULARY") or os.path.join(tokenizer_folder() or "", "byte_bpe_50k.tiktoken")
    try:
        from public_tokenizers import PATTERN as pattern
    except ImportError:
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return Path(path).read_bytes(), pattern


def token_counts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str | None = None, words: bool = False) -> DataFrame:
    """``(doc_id, source_name, n_tokens)``, one row per id; null and empty texts have 0 tokens.

    ``vocabulary`` is the path of a ranked byte-level vocabulary on the driver
    (by default the one that ``SKEIN_VOCABULARY`` names, or of the installed
    public tokenizers); special tokens in a text count as ordinary text.  With
    ``words`` runs of letters and digits are counted instead.  Source names
    compare in lower case, with ``_`` for ``-``, without outer blanks.  Of
    several rows of one id the smallest (source, text) counts.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), source_name(F.col(source)).alias("source_name"), F.col(text).alias("t")).where(F.col("doc_id").isNotNull())
    if words:
        counted = rows.select("doc_id", "source_name", F.coalesce(F.regexp_count("t", F.lit(r"[\p{L}\p{N}]+")), F.lit(0)).cast("long").alias("n_tokens"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(_vocabulary(vocabulary))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import tiktoken

            lines, pattern = shared.value
            ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, lines.splitlines())}
            coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            for b in batches:
                counts = [len(coder.encode_ordinary(t)) if t else 0 for t in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64())], names=["doc_id", "source_name", "n_tokens"])

        counted = rows.mapInArrow(run, "doc_id bigint, source_name string, n_tokens bigint")
    return counted.groupBy("doc_id").agg(F.min(F.struct("source_name", "n_tokens")).alias("m")).select("doc_id", "m.*")


def source_name(c: Column) -> Column:
    """Clean name of a source label; blank counts as null."""
    t = F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), "-", "_")
    return F.when(t != "", t)


def _bucket(h: Column, n: int) -> Column:
    return F.shiftright(F.shiftrightunsigned(h, 33) * F.lit(n), 31).cast("int")


def _running(df: DataFrame, by: list[str], bucket: str, order: list[str], value: Column) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over the rows ahead, per ``by``, bucket by bucket."""
    df = df.withColumn("value", value)
    sums = df.groupBy(*by, bucket).agg(F.sum("value").alias("v"))
    ahead = sums.withColumn("ahead", F.coalesce(F.sum("v").over(Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("v")
    inner = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("inner", F.coalesce(F.sum("value").over(inner), F.lit(0))).join(ahead, [*by, bucket]).withColumn("before", F.col("ahead") + F.col("inner")).drop("inner", "ahead", "value")


def plan_mixture(tokens: DataFrame, targets: DataFrame) -> DataFrame:
    """Wanted and reachable tokens of each target source, written once.

    ``(source_name, target_share, max_repeats, docs_available, tokens_available, wanted, amount)``.
    The mixture's size is ``size_factor`` times all tokens; a source gets its
    share of that, or all its tokens ``max_repeats`` times if that is less.
    Targets without a name are none; of a repeated name the largest row counts.
    """
    held = tokens.groupBy("source_name").agg(F.sum("n_tokens").alias("tokens_available"), F.count(F.lit(1)).alias("docs_available"))
    total = tokens.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    number = lambda c, t: F.coalesce(F.col(c).cast(t), F.lit(0).cast(t)).alias(c)
    named = targets.where(F.col("source_name").isNotNull()).groupBy("source_name").agg(F.max(F.struct(number("target_share", "double"), number("max_repeats", "int"), number("size_factor", "double"))).alias("m")).select("source_name", "m.*")
    plan = named.join(held, "source_name", "left").select("source_name", "target_share", "max_repeats", number("docs_available", "bigint"), number("tokens_available", "bigint"), (F.col("target_share") * F.col("size_factor") * F.lit(float(total))).alias("wanted"))
    reach = F.greatest(F.lit(0.0), F.least(F.col("wanted"), F.col("tokens_available") * F.col("max_repeats").cast("double")))
    return written(plan.withColumn("docs_available", F.when(F.col("tokens_available") > 0, F.col("docs_available")).otherwise(0)).withColumn("amount", reach), "plan")


def _selected(tokens: DataFrame, plan: DataFrame) -> DataFrame:
    """Document uses ``(source_name, doc_id, pass_no, n_tokens, start)`` in shuffled order of each pass."""
    last = F.ceil(F.col("amount") / F.col("tokens_available")).cast("int") - 1
    uses = plan.where("tokens_available > 0 and amount > 0").select("source_name", F.explode(F.sequence(F.lit(0), last)).alias("pass_no"), F.col("tokens_available").alias("held"), "amount")
    n = parts_for(tokens.count(), PER_BUCKET)
    few = uses.limit(BROADCAST_USES + 1).count() <= BROADCAST_USES
    rows = tokens.where(F.col("n_tokens") > 0).join(F.broadcast(uses) if few else uses, "source_name").withColumn("h", F.xxhash64("doc_id", "pass_no")).withColumn("bucket", _bucket(F.col("h"), n))
    placed = _running(rows, ["source_name", "pass_no"], "bucket", ["h", "doc_id"], F.col("n_tokens"))
    start = F.col("pass_no") * F.col("held") + F.col("before")
    # The last document is taken if more than half of it fits.
    return placed.withColumn("start", start).where(F.col("start") + F.col("n_tokens") / 2 <= F.col("amount")).select("source_name", "doc_id", "pass_no", "n_tokens", "start")


def _slots(edges: list[float], n_slots: int):
    """``(slot, which)``: source of each slot, by its van der Corput point in the cumulative weights."""
    bits = max(1, (n_slots - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.array(edges)
        for b in batches:
            slot = b.column(0).to_numpy()
            mirrored, rest = np.zeros(len(slot), np.int64), slot.copy()
            for _ in range(bits):
                mirrored = mirrored << 1 | rest & 1
                rest >>= 1
            which = np.minimum(np.searchsorted(bounds, mirrored / 2.0**bits, side="right"), len(bounds) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(which.astype(np.int32))], names=["slot", "which"])

    return run


def scheduled(tokens: DataFrame, plan: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Every document use with the slot of its block: ``(slot_no, source_name, block_no, pass_no, doc_id, n_tokens, start)``."""
    spark = tokens.sparkSession
    chosen = written(_selected(tokens, plan).withColumn("block_no", F.floor(F.col("start") / block_tokens)), "chosen")
    # One number for each wanted source comes to the driver: its blocks.
    sizes = chosen.groupBy("source_name").agg((F.max("block_no") + 1).alias("b")).orderBy("source_name").collect()
    n = sum(r["b"] for r in sizes)
    edges = list(itertools.accumulate(r["b"] / n for r in sizes))
    # An interval of the length 1/n holds one of 4n points or more; slots beyond a source's blocks are spare.
    n_slots = 4 * n + 64
    order = spark.createDataFrame([(k, r["source_name"], int(r["b"])) for k, r in enumerate(sizes)], "which int, source_name string, b bigint")
    slots = spark.range(n_slots, numPartitions=parts_for(n_slots, 1_000_000)).mapInArrow(_slots(edges, n_slots), "slot bigint, which int") if n else spark.createDataFrame([], "slot bigint, which int")
    ranked = _running(slots.withColumn("bucket", F.floor(F.col("slot") / PER_BUCKET)), ["which"], "bucket", ["slot"], F.lit(1))
    placed = ranked.join(F.broadcast(order), "which").where(F.col("before") < F.col("b")).select("source_name", F.col("before").alias("block_no"), F.col("slot").alias("slot_no"))
    return chosen.join(placed, ["source_name", "block_no"]).select("slot_no", "source_name", "block_no", "pass_no", "doc_id", "n_tokens", "start")


def mixture_report(docs: DataFrame, targets: DataFrame, *, block_tokens: int = BLOCK_TOKENS, **names) -> DataFrame:
    """Per target source: documents and tokens in the schedule, most uses of a document, and actual share.

    ``(source_name, target_share, docs_available, tokens_available, tokens_wanted,
    docs_used, uses, tokens_used, repeats, actual_share)``, counted over the slots
    of :func:`mixture_schedule`; sources that do not exist have zeros.
    ``actual_share`` is of all tokens used.
    """
    tokens = written(token_counts(docs, **names), "tokens")
    plan = plan_mixture(tokens, targets)
    uses = scheduled(tokens, plan, block_tokens).groupBy("source_name", "doc_id").agg(F.count("slot_no").alias("uses"), F.sum("n_tokens").alias("t"))
    used = written(uses.groupBy("source_name").agg(F.count(F.lit(1)).alias("docs_used"), F.sum("uses").alias("uses"), F.sum("t").alias("tokens_used"), F.max("uses").alias("repeats")), "used")
    total = used.agg(F.coalesce(F.sum("tokens_used"), F.lit(0))).first()[0]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return plan.join(used, "source_name", "left").select("source_name", "target_share", "docs_available", "tokens_available", F.round("wanted").cast("bigint").alias("tokens_wanted"), zero("docs_used"), zero("uses"), zero("tokens_used"), zero("repeats"), (F.coalesce("tokens_used", F.lit(0)) / F.lit(float(max(total, 1)))).alias("actual_share"))


def mixture_schedule(docs: DataFrame, targets: DataFrame, *, block_tokens: int = BLOCK_TOKENS, **names) -> DataFrame:
    """The mixture in order: ``(slot_no, source_name, block_no, pass_no, doc_id, n_tokens, start)``.

    Sort by ``slot_no``, then by ``start``.  Every document use that
    :func:`mixture_report` counts occurs once.
    """
    tokens = written(token_counts(docs, **names), "tokens")
    return scheduled(tokens, plan_mixture(tokens, targets), block_tokens)
