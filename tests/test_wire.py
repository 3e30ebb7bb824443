import base64
import json
import random

import pytest
from pyspark.sql import functions as F

from roadpulse.functions.wire import decode_batch, report_class
from roadpulse.operators.ingest import decode_telemetry, normalize_ingest
from tests.samples import NOW, VIN_A, raw, wire


def decode(spark, *values):
    return decode_telemetry(raw(spark, *values)).orderBy("offset").collect()


def test_decodes_all_fields(spark):
    (r,) = decode(spark, wire(soc=55.3))
    assert (r["vin"], r["lng"], r["lat"], r["status_code"], r["device_timestamp"]) == (
        VIN_A, -122.41, 37.77, 2, NOW
    )
    assert float(r["battery_soc"]) == pytest.approx(55.3) and r["decode_error"] is None


def test_errors_are_rows(spark):
    bad_utf8 = b"\x0a\x02\xff\xfe"
    extra = wire() + b"\x9a\x06\x03abc"
    got = decode(spark, b"", b"not a message", bad_utf8, wire()[:-3], extra, wire(status=7))
    assert [r["decode_error"] is None for r in got] == [True, False, False, False, True, True]
    assert (got[0]["vin"], got[0]["lat"], got[0]["device_timestamp"]) == ("", 0.0, 0)
    assert got[1]["vin"] is None and got[1]["device_timestamp"] is None
    assert got[5]["status_code"] == 7


def envelope(name="payload", text=None, **more):
    text = base64.b64encode(wire()).decode() if text is None else text
    return json.dumps({**more, name: text}).encode()


@pytest.mark.parametrize(
    "payload",
    [
        wire(),
        envelope(),
        envelope("Payload"),
        envelope(text=base64.encodebytes(wire()).decode()),
        envelope(other={"payload": "x"}),
        b"  " + envelope(),
    ],
)
def test_payload_forms(spark, payload):
    df = spark.createDataFrame([(payload, 1700000000000)], "payload binary, received_ms long")
    records, refused = normalize_ingest(df)
    (r,) = records.collect()
    assert bytes(r["value"]) == wire() and bytes(r["key"]).decode() == VIN_A
    assert [(h["key"], bytes(h["value"])) for h in r["headers"]] == [
        ("ingest_ts", b"1700000000000")
    ]
    assert refused.count() == 0


@pytest.mark.parametrize(
    "payload, reason",
    [
        (wire(vin=""), "telemetry payload has no VIN"),
        (b"", "telemetry payload has no VIN"),
        (b"not a message", "decode telemetry protobuf"),
        (envelope(text="%%%"), "decode base64 payload"),
        (envelope(text=base64.b64encode(wire()).decode().rstrip("=") + "A"), "decode base64 payload"),
        (envelope(text=""), "decode telemetry protobuf"),
        (envelope(text=5), "decode telemetry protobuf"),
        (b"[1]", "decode telemetry protobuf"),
    ],
)
def test_refused_payloads(spark, payload, reason):
    df = spark.createDataFrame([(payload, 1)], "payload binary, received_ms long")
    records, refused = normalize_ingest(df)
    assert records.count() == 0
    assert refused.first()["reason"].startswith(reason)


def test_decode_keeps_one_python_step(spark):
    """Reading several fields must not decode a record several times."""
    plan = decode_telemetry(raw(spark, wire())).select("vin", "lat", F.col("lng") + 1)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("ArrowEvalPython") == 1 and text.count("decode_report(") <= 2


def test_batches_decode_as_single_messages(spark):
    """Against the message library, on whole, cut, mixed and random bytes."""
    rng = random.Random(9)
    whole = [wire(vin=v, lng=x, status=s, ts=t) for v in ("", VIN_A, "é" * 9) for x in (0.0, -1.5) for s in (0, 7, -3) for t in (0, -5, NOW)]
    more = [b"\x9a\x06\x03abc", b"\x0a\x02\xff\xfe", b"\x0b\x08\x01\x0c", b"\x0c", b"\x00\x01", b"\x20" + b"\xff" * 10, b"\x15abcd", b"\x07"]
    made = list(whole)
    for _ in range(3000):
        parts = b"".join(rng.choice(whole + more) for _ in range(rng.randrange(1, 4)))
        cut = parts[: rng.randrange(len(parts) + 1)] if rng.random() < 0.5 else parts
        made.append(bytes(b if rng.random() > 0.02 else rng.randrange(256) for b in cut))
    found = decode_batch(made)
    for value, r in zip(made, found.itertuples(index=False), strict=True):
        try:
            m = report_class().FromString(value)
        except Exception:
            assert r.decode_error and r.vin is None, value
        else:
            want = (m.vin, m.lng, m.lat, m.status, m.battery_soc, m.device_timestamp)
            got = (r.vin, r.lng, r.lat, r.status_code, r.battery_soc, r.device_timestamp)
            assert r.decode_error is None and [repr(float(x)) if isinstance(x, float) else x for x in want] == [
                repr(float(x)) if isinstance(x, float) else x for x in got
            ], value
