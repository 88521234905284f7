"""Identifiers and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as K


def request_id(trace_id: Column, doc_hash: Column, version: Column) -> Column:
    return F.md5(F.concat_ws("|", trace_id, doc_hash, version.cast("string")))


def uuid5(name: Column, namespace_hex: str = K.UUID_DNS_NAMESPACE) -> Column:
    """Name-based version 5 UUID from SHA-1, with version and variant bits set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.lower(
        F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8)))
    )
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def point_id(doc_hash: Column, version: Column, chunk_id: Column) -> Column:
    return uuid5(F.concat_ws(":", doc_hash, version.cast("string"), chunk_id))


def chunk_id(doc_hash: Column, index: Column) -> Column:
    return F.format_string("%s-%04d", F.substring(doc_hash, 1, 8), index)


def chunk_index(chunk_id_: Column) -> Column:
    """Trailing four-digit index, 10^9 where there is none, so such chunks sort last."""
    return F.coalesce(F.nullif(F.regexp_extract(chunk_id_, r"-(\d{4})$", 1), F.lit("")).cast("int"), F.lit(10**9))


def chunk_key(chunk_id_: Column, doc_hash: Column, source_block_ids: Column) -> Column:
    fallback = F.concat_ws(":", doc_hash, F.get(source_block_ids, F.lit(0)))
    return F.coalesce(F.nullif(chunk_id_, F.lit("")), fallback)


def cache_key(text: Column, model: Column) -> Column:
    return F.concat_ws("|", F.sha2(text, 256), model)


def lot_label(filename: Column) -> Column:
    """'Lot N' from a file name, leading zeros dropped, else null."""
    number = F.regexp_extract(filename, K.LOT, 1)
    return F.when(number != "", F.concat(F.lit("Lot "), number.cast("decimal(38,0)").cast("string")))


def strip_run_suffix(doc_hash: Column) -> Column:
    return F.regexp_replace(doc_hash, K.RUN_SUFFIX, "")
