import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import common, licenses, mpegts, registry


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=3000))
def test_stream_round_trip(data):
    payload = mpegts.pad(data)
    media = mpegts.mux(payload)
    s = mpegts.demux(media)
    assert s.payload == payload and not s.error and s.breaks == 0 and len(media) % 188 == 0 and set(media[::188]) == {0x47}
    assert s.pts == [k * mpegts.TICKS for k in range(len(payload) // 576)] and s.random_access == s.pts[:: mpegts.RANDOM_ACCESS]


def test_broken_streams():
    media = mpegts.mux(mpegts.pad(b"x" * 2000))
    assert mpegts.demux(b"").error == "length" and mpegts.demux(media[:-1]).error == "length"
    assert mpegts.demux(b"\0" + media[1:]).error == "sync"
    assert mpegts.demux(media[:20] + b"\1" + media[21:]).error in ("tables", "")
    assert mpegts.demux(media[188 * 2 :]).error == "tables"
    lost = media[: 188 * 7] + media[188 * 8 :]
    assert mpegts.demux(lost).breaks == 1 and mpegts.demux(lost).error == "short unit"
    whole = mpegts.demux(media)
    twice = mpegts.demux(media[: 188 * 8] + media[188 * 7 :])
    assert (twice.payload, twice.breaks, twice.error) == (whole.payload, 0, "")
    told = bytearray(media[: 188 * 6] + media[188 * 10 :])  # a unit is missing, and the next one says so
    told[188 * 6 + 5] |= 0x80
    got = mpegts.demux(bytes(told))
    assert got.breaks == 0 and not got.error and len(got.payload) == len(whole.payload) - 576


def read_plainly(media):
    """Payload, timestamps and random-access points, packet by packet."""
    tables, stream, units, counter = {}, None, [], None
    for i in range(0, len(media), 188):
        p = media[i : i + 188]
        pid, starts, at = (p[1] & 31) << 8 | p[2], bool(p[1] & 0x40), 4
        flags = 0
        if p[3] & 0x20:
            flags = p[5] if p[4] else 0
            at += 1 + p[4]
        if pid == 0 or pid in tables.values():
            s = p[at + 1 + p[at] :]
            if pid == 0:
                tables[s[8] << 8 | s[9]] = (s[10] & 31) << 8 | s[11]
            else:
                stream = (s[13 + ((s[10] & 15) << 8 | s[11])] & 31) << 8 | s[14 + ((s[10] & 15) << 8 | s[11])]
        elif pid == stream:
            assert counter is None or p[3] & 15 == (counter + 1) % 16
            counter = p[3] & 15
            if starts:
                units.append([b"", bool(flags & 0x40)])
            units[-1][0] += p[at:]
    payload, times, jumps = b"", [], []
    for u, random in units:
        assert u[:3] == b"\0\0\1"
        t = (u[9] >> 1 & 7) << 30 | u[10] << 22 | (u[11] >> 1) << 15 | u[12] << 7 | u[13] >> 1
        times.append(t)
        jumps += [t] * random
        payload += u[9 + u[8] : 6 + (u[4] << 8 | u[5])]
    return payload, times, jumps


def test_stream_with_another_reader():
    for n in (0, 1, 575, 576, 577, 5000, 30_000):
        data = bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8))
        media = mpegts.mux(mpegts.pad(data))
        s = mpegts.demux(media)
        assert read_plainly(media) == (mpegts.pad(data), s.pts, s.random_access) and s.payload == mpegts.pad(data)


def test_every_row_against_the_contract(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {}
    for r in docs.collect():
        payload = (r["text"] or "").encode()
        n = len(payload)
        payload += b"\xff" * (-n % 576 if n else 576)
        media = mpegts.mux(payload)
        want[r["doc_id"]] = (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest())
    got = registry.op6_transport_stream(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"]: tuple(r[c] for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")) for r in got} == want


def test_timestamps_wrap():
    t = [k * mpegts.TICKS % (1 << 33) for k in range(3)]
    assert mpegts.demux(mpegts.mux(b"a" * 576 * 3)).pts == t


def test_media_on_odd_rows(spark, odd, none):
    got = mpegts.decode(mpegts.encode(odd)).collect()
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], len((r["text"] or "").encode())) for r in odd.select("doc_id", "text").collect())
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"]) for r in got) == want
    empty = next(r for r in got if r["doc_id"] == 2)
    assert empty["payload_sha256"] == hashlib.sha256(b"\xff" * 576).hexdigest() and empty["tail_crc32"] == zlib.crc32(b"\xff" * 32)
    assert mpegts.decode(mpegts.encode(none)).isEmpty()


def brute(text):
    w = common.words((text or "").encode())
    places = [(i, label) for p, label in licenses.BASE.items() for q in [p.encode().split()] for i in range(len(w) - len(q) + 1) if w[i : i + len(q)] == q]
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


TEXTS = [
    "All rights reserved. all-RIGHTS reserved all rights reserved",
    "CC BY-NC 4.0 and cc by, GNU General Public License, version 3.",
    "rights reserved all",
    "",
    None,
    "cc by cc by general public license all rights reserved",
    "ééall rights reserved",
]


def test_scan_against_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").unionByName(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id + 100", "text").toDF("doc_id", "text"))
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    for r in docs.collect():
        x = got[r["doc_id"]]
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"]) == brute(r["text"])
        assert set(filter(None, x["base_labels"].split(","))) <= set(x["labels"].split(",")) and 0 <= x["score"] <= 1
    assert got[1]["labels"] == "cc-by,cc-by-nc-4.0,gpl,gpl-3.0"


@pytest.mark.parametrize(
    "expression,names,value",
    [
        ("MIT", ["mit"], 0.2),
        ("MIT OR GPL-3.0", ["mit", "gpl-3.0"], 0.2),
        ("MIT AND GPL-3.0", ["mit", "gpl-3.0"], 0.6),
        ("GPL-2.0 WITH Classpath-exception-2.0", ["gpl-2.0", "classpath-exception-2.0"], 0.3),
        ("GPL-2.0+ OR LicenseRef-own.1", ["gpl-2.0", "licenseref-own.1"], 0.6),
        ("CC-BY-SA-4.0 some words", ["cc-by-sa-4.0"], 0.5),
        ("(MIT AND GPL-3.0) OR Apache-2.0", ["mit", "gpl-3.0", "apache-2.0"], 0.25),
        ("MIT OR GPL-3.0-only AND AGPL-3.0-or-later", ["mit", "gpl-3.0-only", "agpl-3.0-or-later"], 0.2),
    ],
)
def test_expressions(expression, names, value):
    assert licenses.parse(expression.encode()) == (names, pytest.approx(value))


@pytest.mark.parametrize("expression", ["", "OR MIT", "(MIT", "MIT OR", "()", "and", "see LICENSE", "MIT and more words", "MIT WITH GPL-2.0", "GPL-2.0 WITH Classpath", "gpl-9.9"])
def test_no_expression(expression):
    assert licenses.parse(expression.encode()) is None


def test_tags_and_odd_rows(spark, odd, none):
    docs = spark.createDataFrame([(1, "// SPDX-License-Identifier: (MIT OR Apache-2.0) */\nx"), (2, "SPDX-License-Identifier:"), (3, "SPDX-License-Identifier: see LICENSE"), (4, "spdx license identifier: MIT"), (5, "Éa SPDX-License-Identifier: ISC\r\nspdx-license-identifier:zlib")], "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in licenses.scan(docs).collect()} == {1: "apache-2.0,mit", 2: "", 3: "", 4: "", 5: "isc,zlib"}
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(none).isEmpty()


@settings(max_examples=60, deadline=None)
@given(st.text("aB9é-_ \n", max_size=60))
def test_words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    assert [w.decode() for w in common.words(text.encode())] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
