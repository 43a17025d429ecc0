"""WARC files that others wrote: bytes put together by hand, and what must come out told without our own functions."""

import base64
import gzip
import hashlib
import json
import zlib

import pytest

from tablewatch.llm import warc


def warc_record(version, headers, block):
    return f"WARC/{version}\r\n".encode() + "".join(f"{h}\r\n" for h in headers).encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


PAGE = "<html><title>T</title><body><p>Größe &amp; <a href='/x'>more</a></body></html>"
BODY = PAGE.encode()
SHA1 = "sha1:" + base64.b32encode(hashlib.sha1(BODY).digest()).decode()
CHUNKED = b"5;ext=1\r\n" + BODY[:5] + b"\r\n" + f"{len(BODY) - 5:X}\r\n".encode() + BODY[5:] + b"\r\n0\r\nTrailer: x\r\n\r\n"
RAW = zlib.compressobj(wbits=-15)
DEFLATED = RAW.compress(BODY) + RAW.flush()


def http(*headers, body=BODY):
    return b"HTTP/1.1 200 OK\r\n" + "".join(f"{h}\r\n" for h in headers).encode("latin-1") + b"\r\n" + body


HTML = "Content-Type:text/html; charset=utf-8"
CASES = {
    "plain": (http(HTML), []),
    "repeated": (http(HTML, "Set-Cookie: a=1", "set-cookie:b=2", "X-Folded: one\r\n  two"), []),
    "gzip": (http(HTML, "Content-Encoding: gzip", body=gzip.compress(BODY)), []),
    "deflate": (http(HTML, "Content-Encoding: deflate", body=zlib.compress(BODY)), []),
    "raw deflate": (http(HTML, "Content-Encoding: deflate", body=DEFLATED), []),
    "chunked": (http(HTML, "Transfer-Encoding: chunked", body=CHUNKED), []),
    "chunked gzip": (http(HTML, "Transfer-Encoding:chunked", "Content-Encoding:gzip", body=f"{len(gzip.compress(BODY, mtime=0)):x}\r\n".encode() + gzip.compress(BODY, mtime=0) + b"\r\n0\r\n\r\n"), []),
    "not chunked after all": (http(HTML, "Transfer-Encoding: chunked"), ["transfer-encoding"]),
    "not gzip after all": (http(HTML, "Content-Encoding: gzip"), ["content-encoding"]),
}


def source(name, block, version="1.0", extra=()):
    return warc_record(version, ["WARC-Type:response", f"WARC-Record-ID: <urn:x:{name.replace(' ', '-')}>", "WARC-Date:2020-01-01T00:00:00Z", f"WARC-Target-URI: http://h/{name.replace(' ', '-')}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: {SHA1}", *extra], block)


def split(data):
    """Headers and block of a record of ours, by the standard's grammar."""
    head, block = data.split(b"\r\n\r\n", 1)
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:]), block[:-4]


@pytest.mark.parametrize("name", CASES)
def test_responses_of_others(name):
    block, problems = CASES[name]
    metadata, conversion = map(split, warc.derive(source(name, block)))
    assert conversion[1].decode() == "T\nGröße & more"
    assert metadata[0]["WARC-Refers-To"] == conversion[0]["WARC-Refers-To"] == f"<urn:x:{name.replace(' ', '-')}>"
    assert conversion[0]["WARC-Source-Payload-Digest"] == SHA1 and conversion[0]["WARC-Date"] == "2020-01-01T00:00:00Z"
    assert conversion[0]["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(conversion[1]).digest()).decode()
    about = json.loads(metadata[1])
    assert (about["title"], about["links"], about.get("problems", [])) == ("T", ["/x"], problems)
    if name == "repeated":
        assert about["http"]["set-cookie"] == ["a=1", "b=2"] and about["http"]["X-Folded"] == "one two"


def test_other_codings_and_records():
    unread = json.loads(split(warc.derive(source("br", http(HTML, "Content-Encoding: br", body=b"\x01\x02")))[0])[1])
    assert unread["problems"] == ["content-encoding"]
    dns = warc_record("1.1", ["WARC-Type: response", "WARC-Record-ID: <urn:x:dns>", "Content-Type: text/dns"], b"20200101\nhost 1.2.3.4")
    assert split(warc.derive(dns)[1])[1] == b"20200101\nhost 1.2.3.4"
    assert warc.derive(warc_record("1.0", ["WARC-Type: warcinfo", "WARC-Record-ID: <urn:x:i>"], b"x")) == []


@pytest.mark.parametrize("said", ["sha1:" + base64.b32encode(hashlib.sha1(b"x").digest()).decode(), "sha1:" + hashlib.sha1(b"x").hexdigest(), "md5:" + hashlib.md5(b"x").hexdigest(), "sha256:" + hashlib.sha256(b"x").hexdigest().upper(), "crc9:whatever", None])
def test_digests_of_any_kind(said):
    headers = ["WARC-Type: resource", "WARC-Record-ID: <urn:x:r>"] + ([f"WARC-Block-Digest:{said}"] if said else [])
    assert warc.parse(warc_record("1.0", headers, b"x"))[1] == b"x"
    if said and not said.startswith("crc9"):
        with pytest.raises(ValueError, match="digest"):
            warc.parse(warc_record("1.0", headers, b"y"))


def test_files_of_others(spark, tmp_path):
    """Plain, a member for each record, one member for all; records that are cut off or wrong are told of and the others read."""
    each = [source(name, block) for name, (block, _) in CASES.items()]
    wrong = source("wrong", http(HTML), extra=["WARC-Block-Digest: md5:00"])
    cut = source("cut", http(HTML))[:-40]
    whole = {"plain.warc": b"".join(each) + b"garbage\r\n" + b"".join([each[0], wrong, cut]), "members.warc.gz": b"".join(map(gzip.compress, [*each, cut, wrong, each[0]])), "one.warc.gz": gzip.compress(b"".join(each)), "broken.warc.gz": gzip.compress(each[0]) + b"\x1f\x8b\x08" + b"\xff" * 60, "short.warc.gz": gzip.compress(each[0]) + gzip.compress(each[1])[:-60]}
    for name, data in whole.items():
        (tmp_path / name).write_bytes(data)
    files = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in whole] + [(None,)], "path string")
    found = warc.read_derivatives(warc.build_derivatives(files), with_blocks=True).collect()
    texts = [r.block.decode() for r in found if r.kind == "conversion"]
    assert set(texts) == {"T\nGröße & more"} and len(texts) == 3 * len(each) + 2 + 2
    told = [json.loads(r.block) for r in found if r.kind == "metadata" and r.refers_to is None]
    counts = {n: sum(t["file"].endswith(f"/{n}") for t in told) for n in whole}
    assert counts == {"plain.warc": 3, "members.warc.gz": 2, "one.warc.gz": 0, "broken.warc.gz": 1, "short.warc.gz": 1}
