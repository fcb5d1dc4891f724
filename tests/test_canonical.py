"""Canonical payloads: literals, escapes, repeated keys, collectors' fields, values that are no object."""

import hashlib

import pytest

from watchloom.sources import ingest as I
from watchloom.sources.canonical import canonical, with_payload_hash


@pytest.mark.parametrize(
    ("text", "form"),
    [
        ('{"b": 1.50, "a": [1, 2.0e5, -0]}', '{"a":[1,2.0e5,-0],"b":1.50}'),
        ('{"a":1,"a":2}', '{"a":2}'),
        (' [1] ', "[1]"),
        ('"x"', '"x"'),
        ("null", "null"),
        ('{"u":"<a&b>\\u2028\\u0001\\b\\/"}', '{"u":"\\u003ca\\u0026b\\u003e\\u2028\\u0001\\b/"}'),
        ('{"e":"\\u00e9","z":"é"}', '{"e":"é","z":"é"}'),
        ('{"log":{"file":{"path":"p","inode":1},"offset":1},"agent":{"ephemeral_id":"x"},"event":{"created":1}}', '{"agent":{},"event":{},"log":{"file":{},"offset":1}}'),
        ('{"file":{"path":"p"},"event":"created"}', '{"event":"created","file":{"path":"p"}}'),
        ("not json", None), ("1 2", None), ("NaN", None), ("", None), (None, None), ("[" * 5000, None),
    ],
)
def test_canonical(text, form):
    assert canonical(text) == form


def test_digest_column(spark):
    rows = [(1, '{"record_id":77914,"ts":1790647193.850051}'), (2, '{"ts":1790647193.850051,"record_id":77914}'), (3, '{"ts":1790647193.8500510000001,"record_id":77914}'), (4, "{"), (5, None)]
    got = {r.i: r.payload_hash for r in with_payload_hash(spark.createDataFrame(rows, "i int, payload string")).collect()}
    assert got[1] == got[2] == hashlib.sha256(rows[0][1].encode()).hexdigest() and got[3] not in (got[1], None) and got[4] is got[5] is None


def test_sensor_values(spark):
    ends = '"ts":1,"id.orig_h":"10.0.0.1","id.resp_h":"fe80::1"'
    rows = [(1, f'{{{ends},"service":"-","proto":"-","duration":-1,"orig_bytes":1e3,"resp_bytes":"5"}}'), (2, f'{{{ends},"id.orig_p":80.0,"id.resp_p":"443","duration":0.5,"orig_pkts":1,"resp_pkts":-1}}')]
    got = {r.i: r for r in I.normalize_conn(spark.createDataFrame(rows, "i int, payload string")).collect()}
    assert (got[1].protocol, got[1].transport, got[1].duration, got[1].bytes, got[1].outcome) == (None, None, None, 1005, "unknown")
    assert (got[2].source_port, got[2].destination_port, got[2].duration, got[2].packets) == (None, 443, 500_000_000, None)
    dns = I.normalize_dns(spark.createDataFrame([(f'{{{ends},"query":"q","rcode_name":"-"}}',)], "payload string")).first()
    assert (dns.question, dns.response_code, dns.outcome, dns.error_code) == ("q", None, "unknown", None)
    http = I.normalize_http(spark.createDataFrame([(f'{{{ends},"host":"h","status_code":"-"}}',)], "payload string")).first()
    assert (http.outcome, http.status_code, http.path) == ("unknown", None, "/")
