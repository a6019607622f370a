"""JSON payloads: the gate, leaves, path and key rules, and rewriting.

Whether a body is JSON and what its strings are needs a strict decoder, so decoding and re-encoding are two Arrow-batched Python
steps; all rules between them are expressions. Keys are visited in sorted order, which is also the order of the
output and of placeholder numbers. Numbers keep their text; of repeated keys the last counts. A body that is not exactly
one JSON value is plain text. changed tells whether any string changed, reencoded whether only the form did.
A null body stays null. Bodies nested deeper than the decoder allows are plain text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, fields, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.recognizers import CARD_WINDOW, SECRET_WINDOW, profile_of
from veilspan.operators import spans as S

# Paths that are scrubbed and left alone by default.
INCLUDE = ("messages.*.content", "messages.*.content.*.text", "input", "input.*.content", "input.*.content.*.text", "prompt", "prompts.*", "system", "instructions", "conversation.*.content", "metadata.*")
EXCLUDE = ("model", "role", "stream", "temperature", "top_p", "max_tokens", "max_completion_tokens", "tool_choice", "response_format.type", "tools.*.function.name", "functions.*.name")

# Terms that make a key sensitive, by type; the first that fits counts.
KEY_TERMS = (
    ("SECRET", ("apikey", "accesskey", "secret", "clientsecret", "token", "authtoken", "authorization", "password", "passwd", "pwd", "credential", "privatekey", "cookie", "sessionid", "bearer")),
    ("EMAIL", ("email",)),
    ("PHONE", ("phone", "mobile", "telephone")),
    ("SSN", ("ssn", "socialsecurity")),
    ("DOB", ("dob", "dateofbirth", "birthdate")),
    ("ADDRESS", ("address",)),
    ("PERSON", ("fullname", "firstname", "lastname", "patientname", "customername", "contactname", "legalname")),
    ("ID", ("accountid", "accountnumber", "customerid", "customernumber", "memberid", "membernumber", "claimid", "claimnumber", "policyid", "policynumber", "patientid", "caseid", "casenumber")),
)


@dataclass(frozen=True)
class Policy:
    """What of a payload is scrubbed."""

    json_mode: str = "all_strings"
    include_paths: Sequence[str] = INCLUDE
    exclude_paths: Sequence[str] = EXCLUDE
    redact_sensitive_json_keys: bool = True
    scrub_plain_text: bool = True

    @staticmethod
    def load(text: str) -> Policy:
        """A policy from JSON; what it leaves out, or gives as null, keeps its default."""
        given = json.loads(text)
        known = {f.name for f in fields(Policy)}
        found = replace(Policy(), **{k: v for k, v in given.items() if k in known and v is not None})
        mode = str(found.json_mode).strip().lower()
        return replace(found, json_mode=mode if mode in ("all_strings", "schema") else "all_strings")


def normal_key(key: Column) -> Column:
    return F.regexp_replace(F.lower(key), "[^a-z0-9]", "")


def key_type(key: Column) -> Column:
    """The type that a key alone gives its value; null if none."""
    k = normal_key(key)
    out = F.lit(None).cast("string")
    for entity, terms in reversed(KEY_TERMS):
        out = F.when(k.rlike("|".join(terms)), F.lit(entity)).otherwise(out)
    return F.when(k.rlike("|".join(t for _, terms in KEY_TERMS for t in terms)), out)


def _path_pattern(pattern: str) -> str | None:
    """A pattern over the keys of a path, lowered and joined by NUL; None for a blank one."""
    parts = pattern.strip().lower().split(".")
    if not pattern.strip():
        return None
    each = [r"[^\x00]*" if p == "*" else re.sub(r"([^\w])", r"\\\1", p, flags=re.ASCII) for p in parts]
    return r"(?:.*\x00)?" + each[0] if len(parts) == 1 else r"\x00".join(each)


def path_matches(path: Column, pattern: str) -> Column:
    """Whether a path fits a dotted pattern: a single part fits the last key at any depth, several fit part by part; *
    fits any key. Case doesn't matter."""
    return any_path(path, [pattern])


def any_path(path: Column, patterns: Sequence[str]) -> Column:
    """Whether a path fits one of some patterns; one search for all of them."""
    known = [p for p in map(_path_pattern, patterns) if p is not None]
    if not known:
        return F.lit(False)
    joined = F.array_join(F.transform(path, lambda k: F.replace(F.lower(k), F.lit("\0"), F.lit("\uffff"))), "\0")
    return (F.size(path) > 0) & joined.rlike(r"(?s)\A(?:" + "|".join(known) + r")\z")


def scrubbed_path(path: Column, policy: Policy) -> Column:
    """Whether a string at a path is searched: never if excluded, else always or if included, by mode."""
    wanted = F.lit(True) if policy.json_mode == "all_strings" else any_path(path, policy.include_paths)
    return ~any_path(path, policy.exclude_paths) & wanted


class _Number(str):
    """A number by its text."""


def strict(body: str | None, content_type: str | None):
    """(True, value) if a body is exactly one JSON value, else (False, None)."""
    if body is None:
        return False, None
    kind = (content_type or "").split(";")[0].strip().lower()
    if kind != "application/json" and body.strip()[:1] not in ("{", "["):
        return False, None

    def refuse(name: str):
        raise ValueError(name)

    try:
        return True, json.loads(body, parse_int=_Number, parse_float=_Number, parse_constant=refuse)
    except (ValueError, RecursionError):
        return False, None


def _walk(value, path: tuple[str, ...]) -> Iterator[tuple[tuple[str, ...], str]]:
    if isinstance(value, dict):
        for k in sorted(value):
            yield from _walk(value[k], (*path, k))
    elif isinstance(value, list):
        for x in value:
            yield from _walk(x, (*path, "*"))
    elif isinstance(value, str) and not isinstance(value, _Number):
        yield path, value


def _rebuilt(value, given: Iterator[str]):
    if isinstance(value, dict):
        return {k: _rebuilt(value[k], given) for k in sorted(value)}
    if isinstance(value, list):
        return [_rebuilt(x, given) for x in value]
    return next(given) if isinstance(value, str) and not isinstance(value, _Number) else value


def encoded(value) -> str:
    """Compact JSON with sorted keys, numbers by their text, and <, > and & escaped."""
    if isinstance(value, _Number):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{encoded(k)}:{encoded(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(encoded, value)) + "]"
    text = json.dumps(value, ensure_ascii=False)
    return text.replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026").replace("\u2028", "\\u2028").replace("\u2029", "\\u2029") if isinstance(value, str) else text


LEAVES = "array<struct<path:array<string>,value:string>>"


def leaves(body: Column, content_type: Column) -> Column:
    """The strings of a JSON body in order, with their paths (* for a list's places); null for plain text."""

    @F.arrow_udf(LEAVES)
    def run(bodies: pa.Array, kinds: pa.Array) -> pa.Array:
        keys, path_ends, values, ends, plain = [], [0], [], [0], []
        for b, k in zip(bodies.to_pylist(), kinds.to_pylist(), strict=True):
            ok, value = strict(b, k)
            plain.append(not ok)
            for path, text in _walk(value, ()) if ok else ():
                keys += path
                path_ends.append(len(keys))
                values.append(text)
            ends.append(len(values))
        paths = pa.ListArray.from_arrays(pa.array(path_ends, pa.int32()), pa.array(keys, pa.string()))
        found = pa.StructArray.from_arrays([paths, pa.array(values, pa.string())], names=["path", "value"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found, mask=pa.array(plain))

    return run(body, content_type)


def judged(body: Column, content_type: Column, policy: Policy) -> Column:
    """The strings of a JSON body in order, each with the type that its key gives it and whether its path is searched: what
    key_type() and scrubbed_path() say, asked once for each path of a batch. Null for plain text."""
    include, exclude = ([re.compile(p, re.DOTALL) for p in map(_path_pattern, patterns) if p] for patterns in (policy.include_paths, policy.exclude_paths))
    by_key, every = policy.redact_sensitive_json_keys, policy.json_mode == "all_strings"

    def judge(path: tuple[str, ...]) -> tuple[str | None, bool]:
        key = re.sub("[^a-z0-9]", "", path[-1].lower()) if path and by_key else ""
        typed = next((entity for entity, terms in KEY_TERMS if any(t in key for t in terms)), None)
        joined = "\0".join(k.lower().replace("\0", "\uffff") for k in path)
        fits = lambda patterns: bool(path) and any(p.fullmatch(joined) for p in patterns)
        return typed, not fits(exclude) and (every or fits(include))

    @F.arrow_udf("array<struct<value:string,typed:string,searched:boolean>>")
    def run(bodies: pa.Array, kinds: pa.Array) -> pa.Array:
        values, typed, searched, ends, plain = [], [], [], [0], []
        known: dict[tuple[str, ...], tuple[str | None, bool]] = {}
        for b, k in zip(bodies.to_pylist(), kinds.to_pylist(), strict=True):
            ok, value = strict(b, k)
            plain.append(not ok)
            for path, text in _walk(value, ()) if ok else ():
                if path not in known:
                    known[path] = judge(path)
                values.append(text)
                typed.append(known[path][0])
                searched.append(known[path][1])
            ends.append(len(values))
        found = pa.StructArray.from_arrays([pa.array(values, pa.string()), pa.array(typed, pa.string()), pa.array(searched, pa.bool_())], names=["value", "typed", "searched"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found, mask=pa.array(plain))

    return run(body, content_type)


def rebuilt(body: Column, content_type: Column, values: Column) -> Column:
    """The body with its strings replaced in order, re-encoded; plain text as it is."""

    @F.arrow_udf("string")
    def run(bodies: pa.Array, kinds: pa.Array, given: pa.Array) -> pa.Array:
        out = []
        for b, k, v in zip(bodies.to_pylist(), kinds.to_pylist(), given.to_pylist(), strict=True):
            ok, value = strict(b, k)
            out.append(encoded(_rebuilt(value, iter(v))) if ok and v is not None else b)
        return pa.array(out, pa.string())

    return run(body, content_type, values)


def explode_leaves(df: DataFrame, id_cols: Sequence[str], body_col: str = "body", type_col: str = "content_type") -> DataFrame:
    """(ids, pos, path, key, value): a row for each string of each JSON body, and one with an empty path for plain text."""
    held = df.select(*id_cols, F.col(body_col).alias("__body"), leaves(F.col(body_col), F.col(type_col)).alias("__leaves"))
    plain = F.array(F.struct(F.array().cast("array<string>").alias("path"), F.col("__body").alias("value")))
    rows = held.select(*id_cols, F.col("__leaves").isNotNull().alias("is_json"), F.posexplode(F.coalesce("__leaves", plain)).alias("pos", "leaf"))
    return rows.select(*id_cols, "is_json", "pos", F.col("leaf.path").alias("path"), F.try_element_at("leaf.path", F.lit(-1)).alias("key"), F.col("leaf.value").alias("value"))


SCRUBBED = ("is_json", "sanitized", "findings", "originals", "changed", "reencoded")

#: Characters that Unicode reserves for internal use; one that a payload lacks parts its strings.
NONCHARACTERS = [chr(c) for c in range(0xFDD0, 0xFDF0)]


def with_scrubbed(df: DataFrame, body_col: str = "body", type_col: str = "content_type", policy: Policy | None = None, **options) -> DataFrame:
    """df with is_json, sanitized, findings, originals, changed and reencoded: each payload rewritten by placeholders that
    are numbered within it. findings: counts by type; originals: placeholder to value. options: as for spans.candidates.

    All is done within the row, so rows that share an id don't meet and nothing is shuffled. The strings of a payload are
    searched as one text, with a separator between them that no pattern or window crosses; a string that its key makes
    sensitive is an empty place there. The rewritten text is cut at the separators again. A payload whose strings hold all
    NONCHARACTERS can't be separated and is withheld: sanitized is null."""
    policy = policy or Policy()
    body, kind = F.col(body_col), F.col(type_col)
    # the transcript profile looks around a span, no further than this
    gap = 1 if profile_of(options.get("profile", "broad")) == "broad" else 1 + max(*CARD_WINDOW, *SECRET_WINDOW)
    held = df.withColumn("__leaves", S.once(judged(body, kind, policy))).withColumn("is_json", F.col("__leaves").isNotNull())
    plain = F.array(F.struct(F.coalesce(body, F.lit("")).alias("value"), F.lit(None).cast("string").alias("typed"), F.lit(policy.scrub_plain_text).alias("searched")))
    held = held.withColumn("__leaves", S.once(F.coalesce("__leaves", plain)))
    every = F.array_join(F.transform("__leaves", lambda x: x["value"]), "")
    free = F.try_element_at(F.filter(F.array(*map(F.lit, NONCHARACTERS)), lambda c: ~F.contains(F.col("__every"), c)), F.lit(1))
    held = held.withColumn("__every", S.once(every)).withColumn("__sign", F.when(~F.contains("__every", F.lit(NONCHARACTERS[0])), NONCHARACTERS[0]).otherwise(free))
    held = held.withColumn("__gap", S.once(F.concat(F.lit("\n"), F.repeat("__sign", F.lit(gap)), F.lit("\n"))))
    # strings that are neither searched nor replaced are left out of the text
    used = F.transform(F.filter("__leaves", lambda x: x["typed"].isNotNull() | x["searched"]), lambda x: F.struct(F.when(x["typed"].isNull(), x["value"]).otherwise("").alias("text"), F.when(x["value"] != "", x["typed"]).alias("typed"), x["value"].alias("value")))
    held = held.withColumn("__used", S.once(used))
    held = held.withColumn("__text", S.once(F.call_function("concat_ws", F.col("__gap"), F.transform("__used", lambda x: x["text"])))).withColumn("__low", S.once(S.folded(F.col("__text"))))
    held = held.withColumn("__found", S.once(S.candidates(F.col("__text"), low=F.col("__low"), inside=True, **options)))

    def typed_step(acc: Column, x: Column) -> Column:
        one = F.struct(acc["at"].alias("start"), acc["at"].alias("end"), x["typed"].alias("entity"), x["value"].alias("value"))
        return F.struct((acc["at"] + F.length(x["text"]) + gap + 2).alias("at"), F.when(x["typed"].isNotNull(), F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    none = F.array().cast(S.SPAN)
    by_key = F.aggregate("__used", F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), typed_step, lambda acc: acc["out"])
    by_key = F.when(F.exists("__used", lambda x: x["typed"].isNotNull()), by_key).otherwise(none)
    found = F.when(F.size("__found") > 0, S.choose(F.col("__found"))).otherwise(none)
    held = held.withColumn("__spans", S.once(F.array_sort(F.concat(by_key, found)))).withColumn("__names", S.once(S.numbered(F.col("__spans"))))
    some = F.size("__spans") > 0
    held = held.withColumn("__parts", S.once(F.when(some, F.split(S.rewrite(F.col("__text"), F.col("__spans"), F.col("__names")), F.col("__gap"), -1))))

    def value_step(acc: Column, x: Column) -> Column:
        taken = x["typed"].isNotNull() | x["searched"]
        return F.struct((acc["at"] + taken.cast("int")).alias("at"), F.concat(acc["out"], F.array(F.when(taken & ~(x["typed"].isNotNull() & (x["value"] == "")), F.get("__parts", acc["at"])).otherwise(x["value"]))).alias("out"))

    merged = F.aggregate("__leaves", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), value_step, lambda acc: acc["out"])
    before = F.transform("__leaves", lambda x: x["value"])
    held = held.withColumn("__values", S.once(F.when(some, merged).otherwise(before)))
    pairs = F.array_distinct(F.transform(F.arrays_zip(F.col("__names").alias("n"), F.col("__spans").alias("s")), lambda x: F.struct(x["n"], x["s"]["value"])))
    held = held.withColumn("__rebuilt", S.once(rebuilt(body, kind, F.col("__values"))))
    sanitized = F.when(F.col("is_json"), F.col("__rebuilt")).when(body.isNotNull(), F.element_at("__values", 1))
    held = held.withColumn("sanitized", F.when(F.col("__sign").isNotNull(), sanitized))
    held = held.withColumns({"findings": S.summary(F.col("__spans")), "originals": F.map_from_entries(pairs), "changed": ~F.col("__values").eqNullSafe(before)})
    held = held.withColumn("reencoded", ~F.col("changed") & ~F.col("sanitized").eqNullSafe(body))
    return held.drop("__leaves", "__every", "__sign", "__gap", "__used", "__text", "__low", "__found", "__spans", "__names", "__parts", "__values", "__rebuilt")


def scrub(df: DataFrame, id_cols: Sequence[str], body_col: str = "body", type_col: str = "content_type", policy: Policy | None = None, **options) -> DataFrame:
    """The ids and what with_scrubbed adds. Rows that share an id, whatever their bodies, stay rows of their own."""
    return with_scrubbed(df.select(*id_cols, F.col(body_col).alias("__body"), F.col(type_col).alias("__type")), "__body", "__type", policy, **options).select(*id_cols, *SCRUBBED)


def rehydrate(df: DataFrame, originals_col: str, body_col: str = "body", type_col: str = "content_type") -> DataFrame:
    """df with a column restored: originals put back into each string of a JSON body, or into plain text."""
    from veilspan.operators.surrogates import restore

    body, kind, names = F.col(body_col), F.col(type_col), F.col(originals_col)
    held = df.withColumn("__leaves", leaves(body, kind))
    values = F.transform("__leaves", lambda x: restore(x["value"], names))
    return held.withColumn("restored", F.when(F.col("__leaves").isNotNull(), rebuilt(body, kind, values)).otherwise(restore(body, names))).drop("__leaves")
