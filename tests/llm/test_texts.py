"""Encoding, packing, archives and page extraction against the libraries and plain Python."""

import hashlib
import io
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunelake.llm import dom, extraction, packing, pieces, warc

tokenizers = pytest.importorskip("public_tokenizers")
PIECES, WORDS = tokenizers.path("piece_bpe_32k.model"), tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", None, " ", "  a  b ", "a\nb", "\n", "\n\n a \n", "\ta\x1cb", "▁a ▁ b", "a▁", "\r\nx\r", "\x00a", "😀 x", "a\xa0b İSTANBUL ΑΣ don't 12345",
    "héé é ﬁ½ ＡＢ", "<s> </s> <|endoftext|>x", "a\x85b　c​d", "it's we'll I'D O'Brien", "word " * 3000, "x" * 5000, "<0x0A> <unk>", "a b" * 500,
]


def test_pieces_equal_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a", "x")], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in pieces.piece_digests(docs, PIECES).collect()}
    ids = {r.doc_id: list(r.ids) for r in pieces.encode_pieces(docs, PIECES).collect()}
    back = {r.doc_id: r.text for r in pieces.decode_pieces(pieces.encode_pieces(docs, PIECES), PIECES).collect()}
    for i, t in [*enumerate(TEXTS), (None, "a")]:
        want = [*model.encode(t or ""), 2]
        assert ids[i] == want and back[i] == model.decode(want)
        assert got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(model.decode(want).encode()).hexdigest()
    assert pieces.piece_digests(docs.limit(0), PIECES).collect() == []


def test_pieces_of_random_texts():
    model = pieces.PieceEncoder(PIECES)
    assert model.split
    model.table.limit = 50
    rng = np.random.default_rng(0)
    letters = list("ab é▁\n\t  .Z0") + ["th", "the "]
    for _ in range(400):
        text = "".join(rng.choice(letters, int(rng.integers(0, 30))).tolist())
        want = [*model.model.encode(text), 2]
        assert model.round_trip([text])[0] == (" ".join(map(str, want)), model.model.decode(want), len(want)), repr(text)


def test_packing(spark):
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(TEXTS)] + [(None, "a b", 3), (0, "again", 3)], "doc_id long, text string, offset int").repartition(3)
    window = 64
    got = packing.pack(docs, WORDS, window).collect()
    whole = packing.WordEncoder(WORDS).whole
    texts = [*enumerate(TEXTS), (None, "a b"), (0, "again")]
    want = sorted((str(i), tuple([*whole.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in texts)
    line = sorted(got, key=lambda r: (r.sequence_id, r.offset))
    place, seen, open_ = 0, [], []
    for r in line:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert divmod(place, window) == (r.sequence_id, r.offset) and r.length == len(ids) >= 1
        assert r.start == len(open_) and r.offset + r.length <= window and r.ids_crc32 == zlib.crc32(bytes(r.ids))
        open_ += ids
        place += len(ids)
        if len(open_) == r.doc_tokens:
            seen.append((str(r.doc_id), tuple(open_)))
            open_ = []
    assert sorted(seen) == want
    assert packing.pack(docs.limit(0), WORDS).collect() == []


def test_words_of_random_texts():
    model = packing.WordEncoder(WORDS)
    rng = np.random.default_rng(0)
    letters = list(map(chr, [*range(33, 127), *range(0xA1, 0x100)])) + list("'’ \n  İſ")
    for _ in range(400):
        text = "".join(rng.choice(letters, 25).tolist())
        assert np.frombuffer(model.encode([text], 2)[0], model.dtype).tolist() == [*model.whole.encode(text, add_special_tokens=False).ids, 2], repr(text)


PAGES = [(1, "u", "x" * 1500), (2, "u", "x" * 1500), (9, None, "x" * 1500), (3, "a\r\nb", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "ü", "é" * 600), (8, "u", "é" * 600), (None, "u", "y" * 2000), (11, "u", "y" * 2000)]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(i, u, h, "clash") for i, u, h in PAGES], "page_id long, url string, html string, record_type string").repartition(2)
    got = {r.page_id: r for r in warc.round_trip(pages, str(tmp_path / "w")).collect()}
    assert len(got) == len(PAGES)
    for i, _, h in PAGES:
        body = (h or "").encode()
        head = max(j for j, _, o in PAGES if o == h and j is not None)
        shared = len(body) >= 1000 and head != i
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        assert (got[i].record_type, got[i].refers_to) == (("revisit", head) if shared else ("response", None))
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_archives_are_cut_and_give_payloads(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    archives = warc.write_archives(warc.plan_records(pages), str(tmp_path / "w"), archive_bytes=400)
    assert archives.count() > 1
    back = {r.page_id: r for r in warc.read_archives(archives).collect()}
    assert all(bytes(back[i].payload) == (h or "").encode() for i, _, h in PAGES if back[i].record_type == "response")
    assert back[7].url == "ü" and back[3].url == "a b"


@pytest.mark.parametrize("harm", ["digest", "length", "cut"])
def test_reader_checks(harm):
    body = b"payload" * 50
    record = warc.record_bytes("response", "<urn:page:1>", "u", body, hashlib.sha1(body).digest(), None)
    assert list(warc.read_records(io.BytesIO(record * 3)))[2][1] == body
    plain = zlib.decompress(record, 31)
    if harm == "digest":
        plain = plain.replace(b"payloadpayload", b"paylOadpayload", 1)
    elif harm == "length":
        plain = plain[:-6] + plain[-4:]
    packer = zlib.compressobj(wbits=31)
    bad = packer.compress(plain) + packer.flush()
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(bad[:-12] if harm == "cut" else bad)))


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>if(a<b){x="</p>"}</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="ad">Buy now, it is cheap and good.</div>
<article><h1>The headline of it</h1><p><b>First paragraph &lt;one&gt; with
  some   text and a few more words, so that it is long.<br><p>Second number {n} has text too, with commas, and stops. It goes on.</p>
<ul><li>an item of a list in it</ul></article><footer>&copy; example &middot; all rights</footer></body></html>"""
WANT = "The headline of it\nFirst paragraph <one> with some text and a few more words, so that it is long.\nSecond number {n} has text too, with commas, and stops. It goes on.\nan item of a list in it"


def test_extraction(spark):
    rows = [(i, f"u{i}", PAGE.replace("{n}", str(i)), "clash") for i in range(60)]
    odd = [(100, None, None, ""), (101, "u", "", ""), (None, "u", PAGE, ""), (102, "u", "only &amp; text", ""), (103, "u", "<p>a<", ""), (104, "u", "<div " * 50, "")]
    pages = spark.createDataFrame(rows + odd, "page_id long, url string, html string, text string").repartition(3)
    got = {r.page_id: r for r in extraction.extract(pages).collect()}
    assert all(got[i].text == WANT.replace("{n}", str(i)) and got[i].n_chars == len(got[i].text) for i in range(60))
    assert got[100].text == got[101].text == "" and got[102].text == "only & text" and got[None].url == "u"
    assert extraction.extract(pages.limit(0)).collect() == []


def test_extraction_leaves_out_other_parts():
    rng = np.random.default_rng(0)
    x, y = [], []
    for i in range(60):
        page = dom.Page(PAGE.replace("{n}", str(i)))
        for plain in (False, True):
            x.append(dom.features(page, plain))
            y.append(dom.marked(page))
        extraction._disguise(page, rng)
        x.append(dom.features(page))
        y.append(dom.marked(page))
    trees = extraction.Trees(np.concatenate(x), np.concatenate(y))
    parts = '<div class="comments"><p>A reader writes a comment, with some text.</p></div><aside><p>Side text, long enough to be prose.</p></aside><form><p>Your name, please, and more text.</p></form>'
    page = PAGE.replace("<footer>", parts + "<footer>")
    assert extraction.main_texts([page], trees) == [WANT]


@pytest.mark.parametrize("tag", ["video", "object", "svg", "canvas", "audio", "math", "noscript", "template", "select", "iframe"])
def test_unclosed_elements_keep_the_rest_of_the_page(tag):
    for more in ("", f"<{tag}><p>left open</p></{tag}>"):
        page = dom.Page(f"<body><div><{tag} class=x></div><article><p>The text.</p></article>{more}</body>")
        texts = page.blocks([True] * len(page.tag))
        assert "The text." in texts
        assert page.blocks(dom.marked(page)) == ["The text."]


def test_content_of_closed_elements():
    page = dom.Page(
        "<article><p>Where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p><object data=a><p>Fallback text.</p></object>"
        "<script>if (a) '<p>no</p>'</script><select><option>One</select><template><p>two</p></template><p>End.</p><script>rest"
    )
    assert page.blocks([True] * len(page.tag)) == ["Where x=2 holds.", "Fallback text.", "End."]


def test_decoding_is_hierarchical_and_best():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n = 9
        parent = [-1] + [int(rng.integers(0, i)) for i in range(1, n)]
        odds = rng.normal(size=n).tolist()
        best = 0.0
        for mask in range(1 << n):
            if all(not mask >> i & 1 or i == 0 or mask >> parent[i] & 1 for i in range(n)):
                best = max(best, sum(o for i, o in enumerate(odds) if mask >> i & 1))
        keep = extraction.decode(parent, odds)
        assert all(i == 0 or not k or keep[parent[i]] for i, k in enumerate(keep))
        assert abs(sum(o for o, k in zip(odds, keep, strict=True) if k) - best) < 1e-9


def test_pipeline_on_planted_cases(spark, tmp_path):
    """Toxic, equal and near documents go, passages are cut once, clean documents stay as they are."""
    import corpus_pipeline

    rng = np.random.default_rng(7)
    vocabulary = ["".join(rng.choice(list("aeioulnrst"), 6)) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary, n).tolist())
    texts = [prose(150) for _ in range(240)]
    for i in range(0, 240, 4):
        for bad in ("grumblok", "vexwort", "dunghead"):
            texts[i] = texts[i].replace(" ", f" {bad} ", 1)
    passage = prose(70)
    texts[1] = texts[1] + " " + passage
    texts[2] = passage + " " + texts[2]
    near = texts[3].split()
    near[20] = "changed"
    texts += [texts[5], "  ".join(texts[6].split(" ")), " ".join(near), None]
    docs = [(i, t, "en", "s", len(t or ""), True, 7, "f", 1, "k") for i, t in enumerate(texts)]
    extra = "kept boolean, n_bytes int, fp string, bucket int, row_key string"  # names that operators use themselves
    spark.createDataFrame(docs, f"doc_id long, text string, lang string, source string, n_chars long, {extra}").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, frame, str(tmp_path))
        assert after.dtypes == frame.dtypes, name
        after.write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r.doc_id: r.text for r in frame.collect()})
    clean = {i for i in range(240) if i % 4}
    assert set(kept[0]) == clean | {240, 241, 242, 243}
    assert set(kept[1]) == clean | {242, 243} and set(kept[2]) == set(kept[3]) == clean | {243}
    assert all(kept[3][i] == texts[i] for i in clean - {2})
    assert kept[3][2].strip() == texts[2][len(passage) :].strip() and kept[3][243] in (None, "")
    pieces_ = corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path))
    assert pieces_.select("doc_id").distinct().count() == len(clean) + 1
    assert pieces_.agg(F.sum("length")).first()[0] == pieces_.select("doc_id", "doc_tokens").distinct().agg(F.sum("doc_tokens")).first()[0]
