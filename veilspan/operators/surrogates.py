"""Stable placeholders across rows, their vault, and restoring originals.

A scope is organisation, workspace and conversation; a user is not part of it. Within a scope and type, n counts the distinct
values in the order of their first use. Numbering shuffles once, by (scope, type, value), and what is
ordered within a scope and type are distinct values, not occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCOPE = ("org_id", "workspace_id", "conversation_id")
#: The columns of the vault's table.
VAULT = (*SCOPE, "entity", "original_hmac", "original_ciphertext", "surrogate", "n", "created_by", "created_at", "last_seen_at")


def placeholder(entity: Column, n: Column) -> Column:
    return F.concat(F.lit("["), entity, F.lit("_"), n.cast("string"), F.lit("]"))


def assign(findings: DataFrame, scope: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(scope, entity, value, n, surrogate): a number for each distinct value. order: columns whose values tell which
    occurrence is first; ties by value."""
    first = findings.groupBy(*scope, "entity", "value").agg(F.min(F.struct(*order)).alias("first"))
    own = Window.partitionBy(*scope, "entity").orderBy("first", "value")
    numbered = first.withColumn("n", F.row_number().over(own).cast("long"))
    return numbered.select(*scope, "entity", "value", "n", placeholder(F.col("entity"), F.col("n")).alias("surrogate"))


def _scope_key(scope: Sequence[str]) -> Column:
    """A scope as one text; null columns are values of their own."""
    return F.to_json(F.struct(*scope))


def rewrite_scoped(df: DataFrame, id_cols: Sequence[str], scope: Sequence[str], text_col: str = "text", spans_col: str = "spans", order: Sequence[str] = ()) -> DataFrame:
    """df's ids and scope with the text rewritten by placeholders of its scope. df has a spans column. order: columns
    that put the rows of a scope in order; the ids, if none. A row's placeholders follow from its scope, text and spans
    alone and are matched by a digest of these, so rows that share an id don't mix and repeated texts are numbered once."""
    from veilspan.operators.spans import rewrite

    first, spans = [*(order or id_cols)], F.col(spans_col)
    digest = F.when(F.size(spans) > 0, F.sha2(F.concat_ws("\0", _scope_key(scope), F.to_json(spans), F.col(text_col)), 256))
    rows = df.withColumn("__scope", _scope_key(scope)).withColumn("__digest", digest)
    found = rows.where("__digest IS NOT NULL").select("__scope", "__digest", *dict.fromkeys(first), F.posexplode(spans_col).alias("pos", "s"))
    found = found.select("*", F.col("s.entity").alias("entity"), F.col("s.value").alias("value"))
    once = found.select("__scope", "__digest", "pos", "entity", "value").distinct()
    named = once.join(assign(found, ["__scope"], [*first, "pos"]), ["__scope", "entity", "value"])
    names = named.groupBy("__digest").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "surrogate"))), lambda x: x["surrogate"]).alias("__names"))
    back = rows.join(names, "__digest", "left").withColumn("__names", F.coalesce("__names", F.array().cast("array<string>")))
    return back.select(*id_cols, *[c for c in scope if c not in id_cols], rewrite(F.col(text_col), spans, F.col("__names")).alias("redacted"))


def restore(text: Column, originals: Column) -> Column:
    """The text with each placeholder of the map originals replaced in one pass; a restored value is not read again."""
    pattern = r"\[[A-Z_]+_[0-9]+\]"
    gaps, names = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(r"(\[[A-Z_]+_[0-9]+\])"), F.lit(1))
    pairs = F.arrays_zip(F.slice(gaps, 2, F.size(names)).alias("gap"), names.alias("name"))
    done = F.aggregate(pairs, F.element_at(gaps, 1), lambda acc, x: F.concat(acc, F.coalesce(F.element_at(originals, x["name"]), x["name"]), x["gap"]))
    return F.when(F.size(names) > 0, done).otherwise(text)


PLACEHOLDER = r"(\[[A-Z_]+_[0-9]+\])"


def scope_originals(df: DataFrame, mapping: DataFrame, scope: Sequence[str], text_col: str, out: str = "originals") -> DataFrame:
    """df with a map from the placeholders in its text to their originals in its scope; null if it holds none. mapping:
    (scope, surrogate, value). A row is matched, by a digest of scope and text, with the placeholders that it holds, so no
    task gathers the whole mapping of a scope and rows that share an id don't mix."""
    held = F.array_distinct(F.regexp_extract_all(text_col, F.lit(PLACEHOLDER), F.lit(1)))
    digest = F.when(F.col(text_col).rlike(PLACEHOLDER), F.sha2(F.concat_ws("\0", _scope_key(scope), F.col(text_col)), 256))
    rows = df.withColumn("__scope", _scope_key(scope)).withColumn("__digest", digest)
    asked = rows.where("__digest IS NOT NULL").select("__scope", "__digest", F.explode(held).alias("surrogate")).distinct()
    known = mapping.select(_scope_key(scope).alias("__scope"), "surrogate", F.col("value").alias("__value"))
    maps = asked.join(known, ["__scope", "surrogate"]).groupBy("__digest").agg(F.map_from_entries(F.collect_list(F.struct("surrogate", "__value"))).alias(out))
    return rows.join(maps, "__digest", "left").drop("__digest", "__scope")


def restore_scoped(df: DataFrame, mapping: DataFrame, scope: Sequence[str], text_col: str = "text") -> DataFrame:
    """df with restored text. mapping: (scope, surrogate, value), at most one value for each."""
    held = scope_originals(df, mapping, scope, text_col, "__map")
    return held.withColumn("restored", F.when(F.col("__map").isNull(), F.col(text_col)).otherwise(restore(F.col(text_col), F.col("__map")))).drop("__map")


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA-256 in hexadecimal, from two nested digests."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    first = F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), message.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(bytearray(outer)), first), 256)


def original_hmac(key: bytes, scope: Sequence[str] = SCOPE, entity: str = "entity", value: str = "value") -> Column:
    """The vault's look-up key: scope, type and value, each ended by a NUL but the last."""
    nul = F.lit("\0")
    return hmac_sha256(key, F.concat(*[x for c in scope for x in (F.col(c), nul)], F.col(entity), nul, F.col(value)))


def encrypt(value: Column, secret: str) -> Column:
    """AES-256-GCM under SHA-256 of the secret: nonce, ciphertext, tag."""
    return F.aes_encrypt(value, F.unhex(F.sha2(F.lit(secret), 256)), F.lit("GCM"))


def decrypt(value: Column, secret: str) -> Column:
    """The inverse; null if the value is too short or was made with another key."""
    return F.try_aes_decrypt(value, F.unhex(F.sha2(F.lit(secret), 256)), F.lit("GCM")).cast("string")


def upsert(vault: DataFrame, findings: DataFrame, key: bytes, secret: str, now: Column, order: Sequence[str], user: Column | None = None) -> DataFrame:
    """The vault after some findings (scope, entity, value): known values keep their placeholder and are touched, new
    ones are numbered on from the highest of their scope and type."""
    seen = findings.groupBy(*SCOPE, "entity", "value").agg(F.min(F.struct(*order)).alias("first")).withColumn("original_hmac", original_hmac(key))
    ids = [*SCOPE, "entity", "original_hmac"]
    known = vault.join(seen.select(*ids, F.lit(True).alias("__seen")), ids, "left").withColumn("last_seen_at", F.when(F.col("__seen"), now).otherwise(F.col("last_seen_at"))).select(*VAULT)
    new = seen.join(vault.select(*ids), ids, "left_anti")
    highest = vault.groupBy(*SCOPE, "entity").agg(F.max("n").alias("__max"))
    own = Window.partitionBy(*SCOPE, "entity").orderBy("first", "value")
    n = (F.coalesce("__max", F.lit(0)) + F.row_number().over(own)).cast("long")
    new = new.join(highest, [*SCOPE, "entity"], "left").withColumn("n", n)
    new = new.select(*SCOPE, "entity", "original_hmac", encrypt(F.col("value"), secret).alias("original_ciphertext"), placeholder(F.col("entity"), F.col("n")).alias("surrogate"), "n", (user if user is not None else F.lit("")).alias("created_by"), now.alias("created_at"), now.alias("last_seen_at"))
    return known.unionByName(new)


def vault_schema() -> str:
    return "org_id string, workspace_id string, conversation_id string, entity string, original_hmac string, original_ciphertext binary, surrogate string, n long, created_by string, created_at timestamp, last_seen_at timestamp"


def audit_schema() -> str:
    return "org_id string, workspace_id string, conversation_id string, user_id string, request_id string, upstream_model string, findings map<string,int>, denied boolean, status_code int, created_at timestamp"


def migrate(spark, vault_table: str, audit_table: str) -> None:
    """Create the two tables, and add what an older one lacks."""
    for name, schema in ((vault_table, vault_schema()), (audit_table, audit_schema())):
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet")
        have = {f.name for f in spark.table(name).schema}
        if missing := [c for c in schema.replace("map<string,int>", "map<string;int>").split(", ") if c.split(" ")[0] not in have]:
            spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(missing).replace(';', ',')})")
