"""The operators' thin queries over the test tables: each takes (spark, sf_dir)."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..cluster import cut, partitions, shared_folder
from . import anisotropic, chunk_recipes, cross_parsing, keyed_upsert, license_scan, line_quality, logbilinear, mixing, packing, simhash, suffix_index, turn_repair, url_rules
from .common import free_memory, small_batches


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the line-frequency rules; a document's host is its source."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = line_quality.quality(docs, host="source")
    return out.select(F.col("row.doc_id").alias("doc_id"), *line_quality.PROFILE, "left_words", "base_failed", "kept")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of four-word shingles, linked at four bits."""
    near = simhash.near_duplicates(_read(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_suffix_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 200 bytes that repeat."""
    out = suffix_index.without_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.coalesce("kept", F.lit(b""))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.length(kept)).alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2(kept, 256).alias("kept_sha256"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, and its source's size and target."""
    plan = mixing.plan_mix(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return plan.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site and pattern rules' verdicts on every page's URL."""
    judged = url_rules.judge(_read(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "pattern", "verdict")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 1024 tokens, each with its ids' checksum."""
    pieces = packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_logbilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and log-bilinear scores of every document, learned from six sevenths of them."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False)))
    counts, lex, model = logbilinear.fit(docs.where("not held_out"))
    out = logbilinear.score(docs, counts, lex, model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model["tokens"]).cast("bigint").alias("train_tokens"), "base_score", "score")


def op2_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from three quarters of the labelled ones."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))
    return cross_parsing.identify(docs, cross_parsing.fit(docs.where("not held_out")), ["doc_id", "held_out"])


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in every document."""
    found = license_scan.scan(_read(spark, sf_dir, "documents"), ["doc_id"])
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    score = F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0))
    return found.select("doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"), score.alias("score"))


def op7_anisotropic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one."""
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    quantiser = anisotropic.fit(vectors)
    if quantiser is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    indexed = cut(anisotropic.index(vectors, quantiser))
    return anisotropic.search(indexed, F.col("vec_id") % 50 == 0, quantiser)


def _crc(c, n):
    """CRC-32 of a value as decimal text, modulo n."""
    return F.crc32(c.cast("string")) % n


def _client_verdict(first, change):
    """What becomes of a change by the first id of its home."""
    h = _crc(first, 12)
    gone = (change.getField("op") == "D") | (_crc(change.getField("change_id"), 8) < h)
    return F.when(h > 7, "ignore").when(F.coalesce(gone, F.lit(False)), "delete").otherwise("set")


def _file_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, first_id, n_rows, cents, rows_crc, ids_sha256) of rows (path, id, cents, crc) that lie together by file, in order."""
    names, path, own = ["path", "first_id", "n_rows", "cents", "rows_crc", "ids_sha256"], None, None

    def out() -> pa.RecordBatch:
        first, n, cents, crc, ids = own
        return pa.RecordBatch.from_pylist([dict(zip(names, (path, first, n, cents, crc, ids.hexdigest())))], _DIGESTS)

    for b in batches:
        paths, start = b.column(0).to_pylist(), 0
        while start < len(paths):
            stop = next((i for i in range(start, len(paths)) if paths[i] != paths[start]), len(paths))
            ids, cents, crc = (b.column(c).slice(start, stop - start).to_pylist() for c in (1, 2, 3))
            if paths[start] != path:
                if own:
                    yield out()
                path, own = paths[start], [ids[0], 0, 0, 0, hashlib.sha256()]
                own[4].update(str(ids[0]).encode())
                ids, own[1] = ids[1:], 1
            own[4].update("".join(f",{i}" for i in ids).encode())
            own[1:4] = [own[1] + len(ids), own[2] + sum(cents), own[3] + sum(crc)]
            start = stop
    if own:
        yield out()
    free_memory()


_DIGESTS = pa.schema([("path", pa.string()), *((c, pa.int64()) for c in ("first_id", "n_rows", "cents", "rows_crc")), ("ids_sha256", pa.string())])


def op11_keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of a table of clients after their changes, a 700th of all clients in a file."""
    clients, changes = _read(spark, sf_dir, "clients"), _read(spark, sf_dir, "client_changes")
    folder, per_file = f"{shared_folder(spark)}/clients-{uuid.uuid4().hex}", 1 + clients.count() // 700
    chosen = clients.where(_crc(F.col("client_id"), 7) > 3)
    keyed_upsert.start(chosen, folder, "client_id", per_file)
    if not chosen.limit(1).count():
        return spark.createDataFrame([], "first_id long, n_rows long, cents long, rows_crc long, ids_sha256 string, columns string, path string, rewritten boolean")
    untouched = keyed_upsert.upsert(spark, folder, changes, "client_id", ("seq", "change_id"), ("source", "segment", "city", "balance"), per_file, _client_verdict)
    rows = keyed_upsert.table(spark, folder, clients.schema)
    said = F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in ("source", "segment", "city")))
    cents = F.coalesce(F.floor(100 * F.col("balance") + 0.5), F.lit(0)).cast("bigint")
    dealt = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at"), F.col("client_id").alias("id"), cents.alias("cents"), F.crc32(said).alias("crc"))
    files = dealt.repartition(partitions(dealt), "path").sortWithinPartitions("path", "at").select("path", "id", "cents", "crc").mapInArrow(_file_digests, "path string, first_id long, n_rows long, cents long, rows_crc long, ids_sha256 string")
    return files.select("first_id", "n_rows", "cents", "rows_crc", "ids_sha256", F.lit(",".join(rows.columns)).alias("columns"), F.regexp_replace("path", "^file:/+", "/").alias("path"), (~F.col("path").isin(untouched)).alias("rewritten"))


def op12_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates: of equal texts the document of the largest id stays."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    return chunk_recipes.groups(docs).select("row.doc_id", "keep_id", "group_size", "kept", "row.text_sha256")


def _damaged(rows: DataFrame) -> DataFrame:
    """Conversations with what the contract does to them; ``there`` is false for dropped rows."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), _crc(F.concat(said("conv_id"), F.lit(":"), said("turn")), 20).alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("h") != 0).alias("there"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("h") == 3, 2).otherwise(1))).alias("_")).drop("_")


def _turn_digests(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(conv_id, report, repaired_sha256) of repaired turns, each conversation's in order: conv_id, place, report, role, text."""
    head, digest, done = None, None, []
    for b in batches:
        for conv, place, report, role, text in zip(*(c.to_pylist() for c in b.columns)):
            if place == 0:
                if head:
                    done.append((*head, digest.hexdigest()))
                head, digest = (conv, report), hashlib.sha256()
            else:
                digest.update(("" if place == 1 else "\n").encode() + f"{role}:{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], schema.field(i).type) for i in range(3)], schema=schema)
        done = []
    if head:
        yield pa.RecordBatch.from_arrays([pa.array([x], schema.field(i).type) for i, x in enumerate((*head, digest.hexdigest()))], schema=schema)
    free_memory()


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations, their faults, and the cheapest edits that repair them."""
    repaired = turn_repair.repair(_damaged(_read(spark, sf_dir, "conversations")), there=F.col("there")).select("conv_id", "place", "report", "role", "text")
    schema = StructType([repaired.schema["conv_id"], repaired.schema["report"], StructField("repaired_sha256", StringType())])
    out = repaired.mapInArrow(turn_repair.with_schema(_turn_digests, schema), schema)
    return out.select("conv_id", "report.*", "repaired_sha256")


QUERIES = {f.__name__: f for f in (op1_line_quality, op2_cross_parsing, op3_simhash, op4_suffix_index, op5_mixing, op6_url_rules, op7_anisotropic, op8_packing, op9_license_scan, op10_logbilinear, op11_keyed_upsert, op12_chunk_recipes, op13_turn_repair)}
