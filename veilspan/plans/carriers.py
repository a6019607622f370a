"""Texts built from the tables, for recognizers that the tables' own texts don't exercise. Each is (table, id, text), in
SQL that both engines read alike. Values are invented."""

CARRIERS = {
    "documents": ("documents", "doc_id", "text"),
    "pages": ("pages", "page_id", "html"),
    "urls": ("pages", "page_id", "url"),
    "ssn": ("customer", "c_custkey", "concat('é SSN ', lpad(concat('', 50 + c_custkey % 950), 3, '0'), '-', lpad(concat('', c_custkey % 100), 2, '0'), '-', lpad(concat('', c_custkey % 10000), 4, '0'), '.')"),
    "dob": ("orders", "o_orderkey", "concat('Born: ', substr(concat('', o_orderdate), 1, 10), ' ok')"),
    "account": ("customer", "c_custkey", "concat('Account number is C-', lpad(concat('', c_custkey), 6, '0'))"),
    "call": ("customer", "c_custkey", "concat('call +1 415 555 ', lpad(concat('', c_custkey % 10000), 4, '0'))"),
    "key": ("supplier", "s_suppkey", "concat('k sk-', repeat('a', cast(15 + s_suppkey % 10 as int)), ' and sk-ant-', repeat('b', cast(16 + s_suppkey % 8 as int)))"),
    "keys": ("supplier", "s_suppkey", "concat('AK', 'IA', repeat('Q', cast(13 + s_suppkey % 5 as int)), ' gh', 'p_', repeat('x', cast(27 + s_suppkey % 6 as int)), ' xo', 'xb-', repeat('7', cast(18 + s_suppkey % 4 as int)), ' AI', 'za', repeat('z', cast(28 + s_suppkey % 5 as int)))"),
    "jwt": ("supplier", "s_suppkey", "concat('t ey', 'J', repeat('h', cast(8 + s_suppkey % 5 as int)), '.', repeat('p', 12), '.', repeat('s', cast(8 + s_suppkey % 4 as int)), ' end')"),
    "pem": ("supplier", "s_suppkey", "concat('a -----BEGIN RSA PRIVATE', ' KEY-----', chr(10), repeat('Zm9v', cast(1 + s_suppkey % 3 as int)), chr(10), '-----END RSA PRIVATE', case when s_suppkey % 5 = 0 then ' KEY' else ' KEY-----' end, ' b')"),
    "bearer": ("supplier", "s_suppkey", "concat('Authorization: Bearer  ', repeat('t', cast(12 + s_suppkey % 9 as int)), '; password = \"', repeat('w', cast(5 + s_suppkey % 6 as int)), '\"')"),
    "ipv6": ("supplier", "s_suppkey", "concat('peer fe80:0:0:0:0:0:0:', s_suppkey % 9999, ' at 12:34:56')"),
    "person": ("region", "r_regionkey", "concat('My name is ', upper(substr(r_name, 1, 1)), lower(substr(r_name, 2)), '. Thanks')"),
    "address": ("customer", "c_custkey", "concat('Ship address: ', 1 + c_custkey % 9000, ' ', case when c_custkey % 3 = 0 then 'Old Mill' else 'Oak' end, case when c_custkey % 2 = 0 then ' Street' else ' Lane' end, case when c_custkey % 5 = 0 then ', Springfield' else '!' end)"),
    "project": ("part", "p_partkey", "concat('Internal codename Project ', upper(substr(p_name, 1, 1)), lower(substr(p_name, 2)), ' runs')"),
    "iban": ("supplier", "s_suppkey", "concat('IBAN ', case s_suppkey % 4 when 0 then 'GB82 WEST 1234 5698 7654 32' when 1 then 'DE89370400440532013000' when 2 then 'GB82 WEST 1234 5698 7654 33' else 'fr1420041010050500013m02606' end, ';')"),
    "nested": ("customer", "c_custkey", "concat('see https://a.example/p?mail=user', c_custkey, '@example.com&x=1 or user', c_custkey, '@example.com, again user', c_custkey, '@example.com 10.0.0.', c_custkey % 300)"),
    "card": ("customer", "c_custkey", "concat('order ', 4000000000000000 + c_custkey * 7919, case when c_custkey % 2 = 0 then ' card number ' else ' ' end, 4000000000000000 + c_custkey * 104729)"),
    "secrets": ("supplier", "s_suppkey", "concat(case s_suppkey % 4 when 0 then 'pipeline type token: mytoken_value' when 1 then 'secret-store password hunter22hunter22' when 2 then 'api_key=abcd1234efgh' else 'the token tokenizer' end, repeat(' pad', 20), ' password=longenough', s_suppkey)"),
    "talk": ("conversations", "conv_id * 100000 + turn", "concat(text, ' mail u', conv_id, '-', turn % 3, '@example.com and u', conv_id, '-', (turn + 1) % 3, '@example.com')"),
}


def frame(spark, sf_dir: str, name: str):
    """(id, text) of a carrier."""
    table, key, text = CARRIERS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(f"cast({key} as bigint) as id", f"{text} as text")


def source(name: str) -> str:
    """The same as a select."""
    table, key, text = CARRIERS[name]
    return f"SELECT CAST({key} AS BIGINT) AS id, {text} AS text FROM {table}"
