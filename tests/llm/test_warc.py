import base64
import gzip
import hashlib
import json
import random
from html.parser import HTMLParser

from fieldloom.llm import warc
from fieldloom.llm.warc import derivative_report, derivatives, derive, parse, read_warc, response, responses, serialise, visible_text, write_warc

PAGE = "<html><head><title>A &amp; B</title></head><body><h1>Hé</h1><p>one <a href='/x?a=1&amp;b=2'>link</a><br>two</p><script>no</script><img src=i.png></body></html>"


def test_records_are_linked_and_digested():
    source = response("http://a/b", PAGE)
    metadata, conversion = derive(source)
    assert metadata["refers_to"] == conversion["refers_to"] == source["record_id"]
    assert len({source["record_id"], metadata["record_id"], conversion["record_id"]}) == 3
    assert source["payload_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(PAGE.encode()).digest()).decode()
    about = json.loads(metadata["block"])
    assert about["source"]["WARC-Record-ID"] == source["record_id"] and about["http"]["headers"]["Content-Type"].startswith("text/html")
    assert about["html"] == {"title": "A & B", "links": [{"tag": "a", "url": "/x?a=1&b=2"}, {"tag": "img", "url": "i.png"}]}
    assert conversion["block"] == "Hé\none link\ntwo" == visible_text(PAGE)


def test_files_round_trip():
    records = [response("http://a", PAGE), response(None, ""), response("u", "WARC/1.0\r\n\r\nnot a record"), *derive(response("http://a", PAGE))]
    raw = b"".join(serialise(r) + b"\r\n\r\n" for r in records)
    names = [n for n in records[0] if n != "raw"]
    for packed in (raw, gzip.compress(raw), b"".join(gzip.compress(serialise(r) + b"\r\n\r\n") for r in records)):
        assert [{k: r[k] for k in names} for r in parse(packed)] == [{k: r[k] for k in names} for r in records]


def table(spark):
    rows = [(1, "http://a", PAGE, "x"), (2, None, None, "x"), (None, "u\r\nInjected: 1", "", "x"), (3, "http://long", "<p>" + "word " * 100_000, "x")]
    return spark.createDataFrame([*rows, rows[0]], "page_id bigint, url string, html string, type string")


def test_report_from_files(spark, tmp_path):
    got = derivative_report(table(spark), str(tmp_path / "warc")).collect()
    assert sorted((r.page_id for r in got), key=str) == [1, 1, 2, 3, None] and all(r.linked for r in got)
    by = {r.page_id: r for r in got}
    metadata, conversion = derive(response("http://a", PAGE, key="1"), "1")
    assert (by[1].metadata_digest, by[1].conversion_digest, by[1].n_links) == (metadata["block_digest"], conversion["block_digest"], 2)
    assert by[3].text_chars == len(("word " * 100_000).strip()) and by[2].text_chars == 0
    stored = read_warc(spark, str(tmp_path / "warc"))
    assert {r.type for r in stored.collect()} == {"metadata", "conversion"} and stored.count() == 10


def test_responses_from_files_and_empty_tables(spark, tmp_path):
    sources = responses(table(spark))
    write_warc(sources.drop("page_key"), str(tmp_path / "in"), "none")
    again = derivatives(read_warc(spark, str(tmp_path / "in")))
    key = lambda r: (r.record_id, r.refers_to, r.block_digest, r.block)
    assert sorted(map(key, again.collect())) == sorted(map(key, derivatives(sources).collect()))
    empty = spark.createDataFrame([], table(spark).schema)
    assert derivative_report(empty, str(tmp_path / "none")).collect() == []


def test_files_are_cut_by_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 5000)
    rows = [(i, f"http://{i}", "<p>" + "word " * (n := 10 if i % 4 else 400), n) for i in range(40)]
    sources = responses(spark.createDataFrame([*rows, (99, "http://long", "w" * 9000, 0)], "page_id bigint, url string, html string, n int")).drop("page_key").coalesce(1)
    write_warc(sources, str(tmp_path / "in"), "none")
    files = [list(parse(f.read_bytes())) for f in (tmp_path / "in").rglob("part-*")]
    assert len(files) > 4 and all(len(f) == 1 or sum(len(serialise(r)) for r in f) <= 5000 for f in files)
    ids = sorted(r.record_id for r in sources.collect())
    assert sorted(r["record_id"] for f in files for r in f) == ids == sorted(r.record_id for r in read_warc(spark, str(tmp_path / "in")).collect())


class Reader(HTMLParser):
    """Text by blocks and links, by another way than the library's patterns."""

    BLOCKS = set("address article aside blockquote br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split())

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.parts, self.links, self.hidden, self.title = [""], [], 0, None
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in ("head", "script", "style", "noscript", "template"):
            self.hidden += 1
        if tag == "title":
            self.title = ""
        if tag in self.BLOCKS:
            self.parts.append("")
        for name, value in attrs:
            if tag in ("a", "link", "img", "iframe", "source") and name in ("href", "src") and not self.hidden:
                self.links.append({"tag": tag, "url": value.strip()})
                break

    def handle_endtag(self, tag):
        if tag in ("head", "script", "style", "noscript", "template"):
            self.hidden -= 1
        if tag in self.BLOCKS:
            self.parts.append("")

    def handle_data(self, data):
        if self.title == "":
            self.title = " ".join(data.split())
        elif not self.hidden:
            self.parts[-1] += data

    def text(self):
        lines = (" ".join(p.split()) for p in self.parts)
        return "\n".join(line for line in lines if line)


def plain_records(folder):
    """Headers and block of every record in gzip files, cut by their lengths."""
    out = []
    for file in sorted(folder.rglob("part-*")):
        with gzip.open(file) as stream:
            while line := stream.readline():
                assert line == b"WARC/1.0\r\n"
                headers = {}
                while (line := stream.readline()) != b"\r\n":
                    name, value = line.decode().rstrip("\r\n").split(": ", 1)
                    headers[name] = value
                out.append((headers, stream.read(int(headers["Content-Length"]))))
                assert stream.read(4) == b"\r\n\r\n"
    return out


def sha(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_records_against_other_parsers(spark, tmp_path):
    """Files read by plain code, digests by hashlib, text and links by the library's own HTML parser."""
    rng = random.Random(3)
    pages = {}
    for i in range(60):
        body = "".join(
            rng.choice(["<p>{}</p>", "<div class='x'>{}<br>{}</div>", "<ul><li>{}</li><li><a href='/{}?a&amp;b'>{}</a></li></ul>", "<script>no {}</script>", "<h2>{}</h2>", "text {} &lt;tag&gt; &eacute; "]).format(*[rng.choice(["one", "zwei\n drei", "été"])] * 3)
            for _ in range(rng.randint(0, 12))
        )
        pages[i] = f"<html><head><title>Page {i}</title><style>p {{}}</style></head><body>{body}<img src='{i}.png'></body></html>"
    rows = [(i, f"http://h/{i}", html) for i, html in pages.items()]
    got = {r.page_id: r for r in derivative_report(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3), str(tmp_path / "w")).collect()}
    found = plain_records(tmp_path / "w")
    assert len(found) == 2 * len(pages) == 2 * len(got)
    by = {h["WARC-Record-ID"]: (h, block) for h, block in found}
    for i, html in pages.items():
        row, seen = got[i], Reader(html)
        (mh, mb), (ch, cb) = by[row.metadata_id], by[row.conversion_id]
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html.encode())}\r\n\r\n".encode()
        about = json.loads(mb)
        assert mh["WARC-Type"] == "metadata" and ch["WARC-Type"] == "conversion" and mh["WARC-Target-URI"] == ch["WARC-Target-URI"] == row.url == f"http://h/{i}"
        assert mh["WARC-Refers-To"] == ch["WARC-Refers-To"] == row.response_id == about["source"]["WARC-Record-ID"]
        assert mh["WARC-Payload-Digest"] == ch["WARC-Payload-Digest"] == row.payload_digest == sha(html.encode()) == about["source"]["WARC-Payload-Digest"]
        assert about["source"]["WARC-Block-Digest"] == sha(head + html.encode()) and about["page"] == str(i)
        assert mh["WARC-Block-Digest"] == row.metadata_digest == sha(mb) and ch["WARC-Block-Digest"] == row.conversion_digest == sha(cb)
        assert about["html"] == {"title": seen.title, "links": seen.links} and row.n_links == len(seen.links)
        assert cb.decode() == seen.text() and row.text_chars == len(seen.text()) and row.linked


def test_cut_and_damaged_files_lose_only_the_records_hit():
    records = [serialise(response(f"http://{i}", f"<p>{i} WARC/1.0 in a text")) for i in range(4)]
    whole = b"".join(r + b"\r\n\r\n" for r in records)
    ids = [r["record_id"] for r in parse(whole)]
    assert len(ids) == 4
    cut = whole[: len(whole) - 20]
    assert [r["record_id"] for r in parse(cut)] == ids[:3]
    header = whole.rindex(b"WARC/1.0\r\n") + 30
    assert [r["record_id"] for r in parse(whole[:header])] == ids[:3]
    for bad in (b"Content-Length: many", b"Content-Length: -5", b"Content-Length: 99999999", b"X-Other: 1"):
        broken = records[0] + b"\r\n\r\n" + records[1].replace(f"Content-Length: {len(records[1].split(b'\r\n\r\n', 1)[1])}".encode(), bad, 1)
        assert [r["record_id"] for r in parse(broken + b"\r\n\r\n" + records[2] + b"\r\n\r\n" + records[3])] == [ids[0], *ids[2:]]
    packed = [gzip.compress(r + b"\r\n\r\n") for r in records]
    assert [r["record_id"] for r in parse(b"".join(packed)[:-30])] == ids[:3]
    assert [r["record_id"] for r in parse(packed[0] + packed[1][:40])] == ids[:1]
    assert list(parse(b"")) == list(parse(b"\x1f\x8b")) == list(parse(b"no record")) == []
