"""Requests as rows: headers, scope, claims, queries, gates and audit rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.operators import payload, reports, surrogates
from veilspan.operators import spans as S

# Headers that concern one connection, and headers that tell who asks.
HOP_BY_HOP = ("connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade", "content-length")
SENSITIVE_HEADERS = ("authorization", "cookie", "set-cookie", "x-api-key", "x-auth-token", "x-forwarded-for", "x-real-ip", "forwarded", "cf-connecting-ip", "true-client-ip")
REQUEST_IDS = ("X-Request-ID", "X-Correlation-ID", "X-Amzn-Trace-Id")
USER_CLAIMS, ORG_CLAIMS, GROUP_CLAIMS = ("email", "preferred_username", "upn", "sub"), ("tid", "tenant", "org_id"), ("groups", "roles")
MAX_BODY, MAX_MODEL = 2 << 20, 200


def filter_headers(headers: Column, forward_sensitive: bool = False, response: bool = False) -> Column:
    """The headers (a map of lists) that go on."""
    drop = [*HOP_BY_HOP, *(() if forward_sensitive or response else SENSITIVE_HEADERS)]
    return F.map_filter(headers, lambda k, v: ~F.lower(k).isin(drop))


def header(headers: Column, name: str) -> Column:
    """The first value of a header, trimmed; null if there is none or it is blank."""
    values = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name.lower())
    value = F.trim(F.try_element_at(F.try_element_at(values, F.lit(1))["value"], F.lit(1)))
    return F.when(value != "", value)


def within(body: Column, most: int = MAX_BODY) -> Column:
    """Whether a body is small enough, in bytes."""
    return F.coalesce(F.octet_length(body) <= most, F.lit(True))


def claims(token: Column) -> Column:
    """The payload of a token as JSON text; its signature is not verified. Null if it can't be read."""
    part = F.try_element_at(F.split(token, r"\."), F.lit(2))
    plain = F.translate(part, "-_", "+/")
    padded = F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4)).cast("int")))
    text = F.try_to_binary(padded, F.lit("base64")).cast("string")
    return F.when(F.try_parse_json(text).isNotNull() & F.ltrim(text).startswith("{"), text)


def claim(json_text: Column, names: Sequence[str]) -> Column:
    """The first claim among names that is a string and not blank, trimmed."""
    v = F.try_parse_json(json_text)
    found = [F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{n}", "variant")) == "STRING", F.trim(F.try_variant_get(v, f"$.{n}", "string"))) for n in names]
    return F.coalesce(*[F.when(f != "", f) for f in found])


def claim_list(json_text: Column, names: Sequence[str] = GROUP_CLAIMS) -> Column:
    """The strings of claims that are a string or a list."""
    v = F.try_parse_json(json_text)
    empty = F.array().cast("array<string>")
    parts = [F.coalesce(F.try_variant_get(v, f"$.{n}", "array<string>"), F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{n}", "variant")) == "STRING", F.array(F.try_variant_get(v, f"$.{n}", "string"))), empty) for n in names]
    return F.filter(F.concat(*parts), lambda x: x.isNotNull() & (x != ""))


def allowed_group(groups: Column, allowed: Sequence[str]) -> Column:
    """Whether any group may pass; all do if none is named."""
    names = F.array(*[F.lit(a.strip().upper()) for a in allowed]).cast("array<string>")
    return F.lit(True) if not allowed else F.arrays_overlap(F.transform(groups, F.upper), names)


def resolve_scope(df: DataFrame, headers_col: str = "headers", auth: str = "dev", org: str = "default", need_workspace: bool = True, need_conversation: bool = True, groups: Sequence[str] = ()) -> DataFrame:
    """df with org_id, workspace_id, conversation_id, user_id, and rejected: the reason why a request goes no further, or
    null. auth: dev (a header names the user) or alb_oidc (a token does)."""
    h = F.col(headers_col)
    told = claims(header(h, "x-amzn-oidc-data")) if auth == "alb_oidc" else F.lit(None).cast("string")
    df = df.withColumn("__claims", told)
    user = claim(F.col("__claims"), USER_CLAIMS) if auth == "alb_oidc" else F.coalesce(header(h, "X-User-ID"), F.lit("dev-user"))
    org_id = F.coalesce(header(h, "X-Org-ID"), claim(F.col("__claims"), ORG_CLAIMS), F.lit(org))
    workspace = F.coalesce(header(h, "X-Workspace-ID"), F.lit(None if need_workspace else "default"))
    conversation = F.coalesce(header(h, "X-Conversation-ID"), F.lit(None if need_conversation else "default"))
    reason = F.when(workspace.isNull(), "missing workspace").when(conversation.isNull(), "missing conversation")
    if auth == "alb_oidc":
        reason = F.when(header(h, "x-amzn-oidc-data").isNull(), "missing identity").when(F.col("__claims").isNull(), "invalid identity").when(user.isNull(), "identity without user").when(~allowed_group(claim_list(F.col("__claims")), groups), "not authorized").otherwise(reason)
    return df.withColumns({"org_id": org_id, "workspace_id": workspace, "conversation_id": conversation, "user_id": user, "rejected": reason}).drop("__claims")


def request_id(headers: Column) -> Column:
    return F.coalesce(*[header(headers, n) for n in REQUEST_IDS], F.concat(F.lit("local-"), F.uuid()))


def model_name(body: Column) -> Column:
    """The top-level model of a JSON body, cut at 200 characters; empty if there is none."""
    v = F.try_parse_json(body)
    name = F.when(F.schema_of_variant(F.try_variant_get(v, "$.model", "variant")) == "STRING", F.try_variant_get(v, "$.model", "string"))
    return F.coalesce(F.substring(name, 1, MAX_MODEL), F.lit(""))


def query_pairs(query: Column) -> Column:
    """The decoded (key, value) pairs of a query string, in order."""
    plain = lambda x: F.try_url_decode(x)
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(plain(F.substring_index(p, "=", 1)).alias("key"), plain(F.when(F.contains(p, F.lit("=")), F.substr(p, F.length(F.substring_index(p, "=", 1)) + 2)).otherwise("")).alias("value")))


def encode_query(pairs: Column) -> Column:
    """A query string of pairs, by key and then by place."""
    ordered = F.array_sort(F.transform(pairs, lambda p, i: F.struct(p["key"].alias("key"), i.alias("i"), p["value"].alias("value"))))
    return F.array_join(F.transform(ordered, lambda p: F.concat(F.url_encode(p["key"]), F.lit("="), F.url_encode(p["value"]))), "&")


def scrub_query(df: DataFrame, query_col: str, **options) -> DataFrame:
    """df with scrubbed_query: values under sensitive keys replaced whole, others searched; placeholders are numbered
    within a row, keys in order. Also query_findings."""
    pairs = F.array_sort(F.transform(query_pairs(F.col(query_col)), lambda p, i: F.struct(p["key"].alias("key"), i.alias("i"), p["value"].alias("value"))))

    def found(p: Column) -> Column:
        typed, value = payload.key_type(p["key"]), p["value"]
        whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.length(value).cast("long").alias("end"), typed.alias("entity"), value.alias("value")))
        return F.when(typed.isNotNull() & (value != ""), whole).when(typed.isNotNull(), F.array().cast(S.SPAN)).otherwise(S.choose(S.candidates(value, **options)))

    held = df.withColumn("__pairs", pairs).withColumn("__found", F.transform("__pairs", lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value"), found(p).alias("spans"))))
    held = held.withColumn("__spans", F.flatten(F.transform("__found", lambda x: x["spans"]))).withColumn("__names", S.numbered(F.col("__spans")))
    offset = lambda i: F.aggregate(F.slice("__found", 1, i), F.lit(0), lambda a, q: a + F.size(q["spans"]))
    out = F.transform("__found", lambda x, i: F.struct(x["key"].alias("key"), S.rewrite(x["value"], x["spans"], F.slice("__names", offset(i) + 1, F.size(x["spans"]))).alias("value")))
    return held.withColumn("scrubbed_query", encode_query(out)).withColumn("query_findings", S.summary(F.col("__spans"))).drop("__pairs", "__found", "__spans", "__names")


def target_url(base: Column, path: Column, query: Column) -> Column:
    """Base and path with one slash between them, and the query if there is one."""
    joined = F.concat(F.regexp_replace(base, "/$", ""), F.lit("/"), F.regexp_replace(path, "^/", ""))
    return F.when(query != "", F.concat(joined, F.lit("?"), query)).otherwise(joined)


def finding_headers(counts: Column) -> Column:
    """The headers that tell of findings."""
    return F.map_from_arrays(F.array(F.lit("Findings"), F.lit("Entities")), F.array(reports.total(counts).cast("string"), reports.compact(counts, "=")))


def process(df: DataFrame, id_col: str, deny: Sequence[str] = (), max_body: int = MAX_BODY, policy: payload.Policy | None = None, scope: dict | None = None, **options) -> DataFrame:
    """Requests (id, headers, query, body, content_type) to what goes on: scope, sanitized body and query, findings over
    both, denied types, and status: 401 without a scope, 413 for a body too large, 400 if a type is denied, else 200; also the
    originals of the body's placeholders, which answer() turns back, and path if df has it."""
    rows = resolve_scope(df, **(scope or {}))
    early = F.when(F.col("rejected").isNotNull(), 401).when(~within(F.col("body"), max_body), 413)
    rows = scrub_query(rows.withColumn("status", early), "query", **options)
    # a request that goes no further has no body from here on
    live = F.when(F.col("status").isNull(), F.col("body"))
    rows = payload.with_scrubbed(rows.withColumn("__live", live), "__live", "content_type", policy, **options)
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))
    out = rows.withColumn("findings", F.when(F.col("status").isNull(), reports.merge(F.coalesce("findings", none), F.coalesce("query_findings", none))).otherwise(none))
    out = out.withColumn("denied", reports.denied(F.col("findings"), deny)).withColumn("request_id", request_id(F.col("headers"))).withColumn("model", model_name(F.col("body")))
    return out.withColumn("status", F.coalesce("status", F.when(F.size("denied") > 0, 400).otherwise(200))).select(id_col, "org_id", "workspace_id", "conversation_id", "user_id", "request_id", "model", "rejected", "sanitized", "scrubbed_query", "findings", "denied", "status", "originals", *[c for c in ("path",) if c in df.columns])


def audit(processed: DataFrame, now: Column) -> DataFrame:
    """An audit row for each request that had a scope and a body of allowed size."""
    done = processed.where(~F.col("status").isin(401, 413))
    return done.select("org_id", "workspace_id", "conversation_id", "user_id", F.coalesce(F.when(F.trim("request_id") != "", F.col("request_id")), F.lit("unknown")).alias("request_id"), F.col("model").alias("upstream_model"), "findings", (F.size("denied") > 0).alias("denied"), F.col("status").alias("status_code"), now.alias("created_at"))


def echo(processed: DataFrame, id_col: str, elapsed_ms: Column | None = None, policy: payload.Policy | None = None, rehydrates: bool = False, show_path: bool = False) -> DataFrame:
    """The report of each request that goes on, as JSON. The path is shown only if asked for and known.
    policy: the one that process() was given."""
    path = F.col("path") if show_path and "path" in processed.columns else F.lit("redacted")
    fields = {
        "elapsed_ms": F.lit(0).cast("long") if elapsed_ms is None else elapsed_ms,
        "findings": F.map_from_entries(F.array_sort(F.map_entries("findings"))),
        "json_mode": F.lit((policy or payload.Policy()).json_mode),
        "mode": F.lit("echo"),
        "path": path,
        "redacted": reports.total(F.col("findings")) > 0,
        "response_rehydration_on": F.lit(rehydrates),
        "sanitized_body": F.coalesce("sanitized", F.lit("")),
        "sanitized_query": F.coalesce("scrubbed_query", F.lit("")),
    }
    report = F.to_json(F.struct(*[c.alias(name) for name, c in fields.items()]))
    return processed.where("status = 200").select(id_col, report.alias("echo"))


def answer(df: DataFrame, body_col: str = "body", type_col: str = "content_type", rehydrate: str = "request", originals_col: str = "originals", mapping: DataFrame | None = None, scope: Sequence[str] = surrogates.SCOPE) -> DataFrame:
    """df with a column restored: the body of a response with placeholders turned back, in each string of a JSON body or in
    plain text. rehydrate: none, request (the originals of the row's own request, a map from placeholders) or scope (mapping's
    (scope, surrogate, value), all that the scope holds)."""
    if rehydrate == "none":
        return df.withColumn("restored", F.col(body_col))
    if rehydrate == "request":
        return payload.rehydrate(df, originals_col, body_col, type_col)
    if rehydrate != "scope" or mapping is None:
        raise ValueError("rehydrate must be none, request, or scope with a mapping")
    held = surrogates.scope_originals(df, mapping, scope, body_col, "__map")
    whole = payload.rehydrate(held, "__map", body_col, type_col)
    # a body that holds no known placeholder stays as it is written
    return whole.withColumn("restored", F.when(F.col("__map").isNull(), F.col(body_col)).otherwise(F.col("restored"))).drop("__map")
