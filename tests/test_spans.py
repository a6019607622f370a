"""Properties of spans, placeholders and rewriting."""

import hashlib
import hmac
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspan.functions import recognizers as R
from veilspan.functions.dialect import java
from veilspan.operators import detectors, payload, reports, requests, surrogates, tokens
from veilspan.operators import spans as S
from veilspan.sources import files

KEY = "sk-" + "a1" * 12
EVERYTHING = f"Mail ann@example.com or call 415-555-0101 from 10.1.2.3, SSN 123-45-6780, card 4111 1111 1111 1111, {KEY}, born: 1980-02-03, my name is Ana Lima."


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "id long, text string")


def redacted(spark, *values, **options):
    return [r.redacted for r in S.redact(texts(spark, *values), **options).orderBy("id").collect()]


def test_many_kinds_in_one_sentence(spark):
    (out,) = redacted(spark, EVERYTHING)
    for entity in ("EMAIL", "PHONE", "IP_ADDRESS", "SSN", "CREDIT_CARD", "SECRET", "DOB", "PERSON"):
        assert f"[{entity}_1]" in out
    for part in ("ann@", "555-0101", "10.1.2.3", "123-45", "4111", "sk-", "1980", "Ana"):
        assert part not in out


def test_repeated_and_distinct_values(spark):
    assert redacted(spark, "a@x.example b@x.example a@x.example") == ["[EMAIL_1] [EMAIL_2] [EMAIL_1]"]


def test_edges(spark):
    found = redacted(spark, None, "", "nothing", "a@x.example", "é123-45-6780é", "😀 10.0.0.1", "x@y.example,z@y.example", "[EMAIL_1] a@x.example")
    assert found == [None, "", "nothing", "[EMAIL_1]", "é[SSN_1]é", "😀 [IP_ADDRESS_1]", "[EMAIL_1],[EMAIL_2]", "[EMAIL_1] [EMAIL_1]"]


def test_url_beats_the_mail_inside_it(spark):
    assert redacted(spark, "see https://a.example/p?m=a@x.example now") == ["see [URL_1] now"]


def test_transcript_profile(spark):
    noise = "id 4757965300 and 123-45-6780 account deletion project Alpha"
    assert redacted(spark, noise, profile="transcript") == [noise]
    assert redacted(spark, "call 415 555 0101; visa 4111111111111111", profile="transcript") == ["call [PHONE_1]; visa [CREDIT_CARD_1]"]
    assert redacted(spark, "4111111111111111", profile="transcript") == ["4111111111111111"]
    assert redacted(spark, "pipeline token: my_token_value", "password: longenough1", profile="transcript") == ["pipeline token: my_token_value", "password: [SECRET_1]"]


def test_validators_reject(spark):
    for text in ("card 4111111111111112", "0000000000000", "000-12-3456 666-12-3456 900-12-3456 123-00-4567 123-45-0000", "GB82 WEST 1234 5698 7654 33"):
        (r,) = S.with_spans(texts(spark, text), only=["card", "ssn", "iban"]).collect()
        assert r.spans == []


def test_entity_options():
    assert R.entities_of("ip, email,IP") == ("IP_ADDRESS", "EMAIL") and R.entities_of("all") == () and R.entities_of(None) == ()
    assert R.profile_of("odd") == "broad" and R.profile_of("", strict=True) == "transcript"
    for bad in (lambda: R.entities_of("nope"), lambda: R.profile_of("odd", strict=True)):
        with pytest.raises(ValueError):
            bad()


def test_dialect():
    assert java(r"\b\s[^\s\"]\\b").count("(?<") == 2 and java(r"[\s]") == "[\\t\\n\\f\\r ]" and java(r"\\b") == r"\\b"


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["a@x.example", "10.0.0.1", "415-555-0101", KEY, "é", "😀", " ", ",", "password=abcdefgh1", "http://h.example/?q=a@x.example", "[EMAIL_1]", "x"]), max_size=12).map("".join), min_size=1, max_size=8))
def test_spans_are_disjoint_and_restore(spark, values):
    rows = S.redact(texts(spark, *values)).withColumn("names", S.numbered(F.col("spans"))).collect()
    for r in rows:
        at, out = 0, ""
        for s, name in zip(r.spans, r.names, strict=True):
            assert at <= s.start < s.end and r.text[s.start : s.end] == s.value
            out += r.text[at : s.start] + name
            at = s.end
        assert out + r.text[at:] == r.redacted


def test_external_detectors(spark):
    detectors.register_detector("cats", lambda base: base.where("contains(text, 'cat')").select("id", F.lit("PERSON").alias("entity"), (F.instr("text", "cat") - 1).alias("start"), (F.instr("text", "cat") + 2).alias("end"), F.lit("cat").alias("value")))
    detectors.register_detector("broken", lambda base: base.select("nope"))
    df = texts(spark, "a cat", "none", "sk_live_" + "a" * 20 + " and sk_live_" + "a" * 20)
    out = S.redact(detectors.gather(df, "id"), external="external").orderBy("id").collect()
    assert [r.redacted for r in out] == ["a [PERSON_1]", "none", "[SECRET_1] and [SECRET_1]"]
    assert detectors.gather(df, "id").select("errors").distinct().collect() == [(["broken: AnalysisException"],)]
    assert detectors.gather(df, "id", names=["cats"]).select("errors").distinct().collect() == [([],)]
    with pytest.raises(Exception):
        detectors.gather(df, "id", names=["broken"], strict=True)


def test_answers(spark):
    df = spark.createDataFrame(
        [("o", '{"a": "to [EMAIL_1]"}', "application/json", {"[EMAIL_1]": 'q"@x'}), ("p", "[EMAIL_1] [EMAIL_2]", "text/plain", {}), ("o", None, None, None), ("o", '{"a":  1}', "application/json", None)],
        "s string, body string, content_type string, originals map<string,string>",
    )
    known = spark.createDataFrame([("o", "[EMAIL_1]", 'say "x"'), ("p", "[EMAIL_2]", "y")], "s string, surrogate string, value string")
    own = [r.restored for r in requests.answer(df).collect()]
    assert json.loads(own[0]) == {"a": 'to q"@x'} and own[1:3] == ["[EMAIL_1] [EMAIL_2]", None]
    scoped = {r.body: r.restored for r in requests.answer(df, rehydrate="scope", mapping=known, scope=["s"]).collect()}
    assert json.loads(scoped.pop('{"a": "to [EMAIL_1]"}')) == {"a": 'to say "x"'}  # quotes in an original stay valid JSON
    assert scoped == {"[EMAIL_1] [EMAIL_2]": "[EMAIL_1] y", None: None, '{"a":  1}': '{"a":  1}'}
    assert [r.restored for r in requests.answer(df, rehydrate="none").collect()] == [r.body for r in df.collect()]
    with pytest.raises(ValueError):
        requests.answer(df, rehydrate="scope")


def test_payloads(spark):
    rows = [
        (0, '{"messages":[{"role":"user","content":"a@x.example"}],"max_tokens":7,"n":1.50}', "application/json"), (1, '{"a":"a@x.example"}\n{"a":"b@x.example"}', "application/x-ndjson"), (2, "plain a@x.example", None), (3, None, None),
        (4, '{"password":"p","contact_email":"q","account_id":"r","list":{"token":["s"]},"x":"<&"}', ""), (5, "[" * 5000, ""), (6, '{"a":1}{"b":2}', "application/json"), (7, '{"a": "clean"}', ""), (8, '{"model":"a@x.example","deep":{"note":"a@x.example"}}', ""), (9, "", ""),
    ]
    df = spark.createDataFrame(rows, "id long, body string, content_type string")
    out = {r.id: r for r in payload.scrub(df, ["id"]).collect()}
    assert out[0].sanitized == '{"max_tokens":7,"messages":[{"content":"[EMAIL_1]","role":"user"}],"n":1.50}' and out[0].is_json and out[0].originals == {"[EMAIL_1]": "a@x.example"}
    assert out[1].sanitized == '{"a":"[EMAIL_1]"}\n{"a":"[EMAIL_2]"}' and not out[1].is_json and out[2].sanitized == "plain [EMAIL_1]" and out[3].sanitized is None
    assert json.loads(out[4].sanitized) == {"password": "[SECRET_1]", "contact_email": "[EMAIL_1]", "account_id": "[ID_1]", "list": {"token": ["s"]}, "x": "<&"} and "\\u003c\\u0026" in out[4].sanitized
    assert not out[5].is_json and not out[6].is_json and out[7].reencoded and not out[7].changed and out[9].sanitized == ""
    assert json.loads(out[8].sanitized) == {"model": "a@x.example", "deep": {"note": "[EMAIL_1]"}}
    schema = payload.scrub(df.where("id = 8"), ["id"], policy=payload.Policy.load('{"json_mode":"schema","include_paths":["deep.*"],"exclude_paths":null}')).first()
    assert json.loads(schema.sanitized)["deep"] == {"note": "[EMAIL_1]"}
    plain = payload.scrub(df.where("id = 2"), ["id"], policy=payload.Policy(scrub_plain_text=False)).first()
    assert plain.sanitized == "plain a@x.example" and not plain.changed
    assert payload.Policy.load('{"json_mode":" Schema "}').json_mode == "schema" and payload.Policy.load('{"json_mode":"x"}').json_mode == "all_strings"


def test_vault_keys(spark):
    scope = spark.createDataFrame([("o", "w", "c", "EMAIL", "é@x")], "org_id string, workspace_id string, conversation_id string, entity string, value string")
    for key in (b"k", b"k" * 100):
        got = scope.select(surrogates.original_hmac(key).alias("h")).first().h
        assert got == hmac.new(key, "o\0w\0c\0EMAIL\0é@x".encode(), hashlib.sha256).hexdigest()
    enc = scope.select(surrogates.encrypt(F.col("value"), "s").alias("e"))
    r = enc.select(F.length("e").alias("n"), surrogates.decrypt(F.col("e"), "s").alias("a"), surrogates.decrypt(F.col("e"), "t").alias("b"), surrogates.decrypt(F.lit(bytearray(b"xx")), "s").alias("c")).first()
    assert (r.n, r.a, r.b, r.c) == (12 + 4 + 16, "é@x", None, None)


def test_numbering_does_not_depend_on_partitions(spark):
    rows = [("o", "w", "c" + str(k % 3), "EMAIL", f"v{k % 7}", k) for k in range(200)]
    df = spark.createDataFrame(rows, "org_id string, workspace_id string, conversation_id string, entity string, value string, seq long")
    one, many = (sorted(map(tuple, surrogates.assign(df.repartition(n), surrogates.SCOPE, ["seq"]).collect())) for n in (1, 9))
    assert one == many and len(one) == 21


def test_restoring_is_a_single_pass(spark):
    df = spark.createDataFrame([("[EMAIL_1] [EMAIL_2] [EMAIL_10] [X_1]",)], "t string")
    names = F.create_map(F.lit("[EMAIL_1]"), F.lit("[EMAIL_2]"), F.lit("[EMAIL_2]"), F.lit("b"), F.lit("[EMAIL_10]"), F.lit("c"))
    assert df.select(surrogates.restore(F.col("t"), names)).first()[0] == "[EMAIL_2] b c [X_1]"


def test_scope_and_claims(spark):
    import base64

    token = "h." + base64.urlsafe_b64encode(json.dumps({"email": "u@x", "tid": "t1", "groups": ["a"]}).encode()).decode().rstrip("=") + ".s"
    rows = [(0, {"X-Workspace-ID": ["w"], "X-Conversation-ID": ["c"], "X-User-ID": ["me"]}), (1, {}), (2, {"x-amzn-oidc-data": [token], "X-Workspace-ID": ["w"], "X-Conversation-ID": ["c"]}), (3, {"x-amzn-oidc-data": ["junk"], "X-Workspace-ID": ["w"]}), (4, None)]
    df = spark.createDataFrame(rows, "id long, headers map<string,array<string>>")
    dev = {r.id: r for r in requests.resolve_scope(df).collect()}
    assert (dev[0].org_id, dev[0].user_id, dev[0].rejected, dev[1].rejected) == ("default", "me", None, "missing workspace")
    oidc = {r.id: r for r in requests.resolve_scope(df, auth="alb_oidc", groups=["A"]).collect()}
    assert (oidc[2].org_id, oidc[2].user_id, oidc[2].rejected) == ("t1", "u@x", None) and oidc[0].rejected == "missing identity" and oidc[3].rejected == "invalid identity" and oidc[4].rejected
    assert requests.resolve_scope(df, auth="alb_oidc", groups=["b"]).where("id = 2").first().rejected == "not authorized"
    relaxed = requests.resolve_scope(df.where("id = 1"), need_workspace=False, need_conversation=False).first()
    assert (relaxed.workspace_id, relaxed.conversation_id, relaxed.rejected) == ("default", "default", None)


def test_model_tokens(spark):
    rows = [(0, "call 555-0101 now", [("x", "B-phone", 0.9, 5, 13)]), (1, "a Ana Li b", [(" Ana", "private_person", 0.9, 1, 5), (" Li", "private_person", 0.9, 5, 8)]), (2, "", []), (3, None, None), (4, "SECRET x", [("SECRET", "SECRET", 0.99, 0, 6), ("x", "O", float("nan"), 7, 8)])]
    df = spark.createDataFrame(rows, "id long, text string, tokens array<struct<word:string,entity:string,score:double,start:long,end:long>>")
    out = {r.id: r for r in tokens.redact(df).collect()}
    assert [out[k].redacted for k in range(5)] == ["call [REDACTED:phone] now", "a [REDACTED:private_person] b", "", None, "[REDACTED:SECRET] x"]
    place = spark.range(1).select(tokens.located(F.lit("a b a"), F.array(F.lit("a"), F.lit(" a"), F.lit("z"), F.lit(" "))).alias("p")).first().p
    assert [(x.start, x.end) for x in place] == [(0, 1), (4, 5), (None, None), (None, None)]
    with pytest.raises(ValueError):
        tokens.detect(df, min_score=2)


def test_until_clean_and_reports(spark):
    df = texts(spark, "a@x.example", "clean", None)
    out = {r.id: r for r in reports.until_clean(df, "id").collect()}
    assert (out[0].text, out[0].passes, out[0].verified_clean, out[0].findings) == ("[EMAIL_1]", 2, True, {"EMAIL": 1}) and out[1].passes == 1 and out[2].text is None
    rows = reports.report(df, "id")
    assert reports.check(rows).first().exit_code == 2 and reports.check(reports.report(df.where("id = 1"), "id")).first().exit_code == 0
    assert "0 changed=true findings=EMAIL:1" in [r.value for r in reports.summary_text(rows).collect()]
    with pytest.raises(ValueError):
        reports.until_clean(df, "id", passes=0)


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a@x.example\nb")
    df = files.scan_texts(spark, str(tmp_path / "a.txt"))
    rows = reports.report(df, "path")
    path = files.write_changed(rows, str(tmp_path / "out"), "1")
    assert spark.read.parquet(path).first().redacted == "[EMAIL_1]\nb"
    with pytest.raises(Exception):
        files.write_changed(rows, str(tmp_path / "out"), "1")
    ok, big = files.bounded(spark.createDataFrame([("é" * 3,), ("x",), (None,)], "body string"), most=5)
    assert (ok.count(), big.count()) == (2, 1)
    files.write_summary(rows, str(tmp_path / "s"))
    assert json.loads(spark.read.text(str(tmp_path / "s")).first().value)["findings"] == {"EMAIL": 1}
    for bad in ({"passes": 0}, {"check": True, "in_place": True}, {"backup": True}, {"in_place": True, "output": "x"}, {"remove_backup": True}):
        with pytest.raises(ValueError):
            files.validate_options(["a"], **bad)
    with pytest.raises(ValueError):
        files.validate_options(["a", "b"], output="x")


def test_stream_numbers_like_the_batch(spark, tmp_path):
    from veilspan.streaming.surrogates import number_stream

    rows = [("o", "w", "c", "EMAIL", k, f"v{(k * 5) % 7}") for k in range(30)]
    schema = "org_id string, workspace_id string, conversation_id string, entity string, sequence long, value string"
    for part in range(3):
        spark.createDataFrame(rows[part * 10 : part * 10 + 10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = number_stream(stream).writeStream.format("memory").queryName("numbered").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    got = {r.value: r.surrogate for r in spark.table("numbered").collect()}
    want = {r.value: r.surrogate for r in surrogates.assign(spark.createDataFrame(rows, schema), surrogates.SCOPE, ["sequence"]).collect()}
    assert got == want and spark.table("numbered").count() == 30
