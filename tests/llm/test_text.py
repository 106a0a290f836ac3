"""Word hashing, tokens, JPEG, language and classifier pieces without Spark."""

import hashlib
import time
import re
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinetable.llm import byte_bpe, hmm, html_extract, jpeg, language_id, media, quality, textcore, toxicity

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

ODD = [None, "", " ", "aB cd  ab", "x", "a" * 300 + " " + "A" * 300, "ab", "cd ef", "q" * 300_000 + " z", "\t\n", "no break é E", " "]


def brute_words(x):
    return re.findall(rb"[^\x20\x09-\x0D]+", (x or "").encode())


def lower(w):
    return re.sub(rb"[A-Z]", lambda m: m.group().lower(), w)


def test_words():
    buf, off = textcore.utf8(pa.array(ODD))
    begin, end, row, h = textcore.words(buf, off)
    want = [(i, w) for i, x in enumerate(ODD) for w in brute_words(x)]
    assert [(int(i), bytes(buf[a:b])) for i, a, b in zip(row, begin, end)] == want
    seen = {}
    for (_, w), x in zip(want, h.tolist()):
        assert seen.setdefault(lower(w), x) == x
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab \n", max_size=30), max_size=6), st.integers(1, 5))
def test_shingles(texts, width):
    buf, off = textcore.utf8(pa.array(texts, pa.string()))
    _, _, row, h = textcore.words(buf, off)
    sets, starts = textcore.distinct(*textcore.shingles(row, h, len(texts), width))
    for i, x in enumerate(texts):
        w = brute_words(x)
        want = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
        assert starts[i + 1] - starts[i] == len(want)


@pytest.fixture(scope="module")
def tokenizer():
    return byte_bpe.Tokenizer(byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)


@pytest.fixture(scope="module")
def reference(tokenizer):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tokenizer.ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.text("ab'st ²½\n \x1c\x85é世1.,ll've", max_size=60))
def test_bpe(tokenizer, reference, x):
    ids = tokenizer.encode(x)
    assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(x)
    assert tokenizer.decode([ids, b""]) == [x.encode(), b""]


def test_bpe_long(tokenizer, reference):
    x = "ab" * 20_000
    assert np.frombuffer(tokenizer.encode(x), "<u4").tolist() == reference.encode_ordinary(x)


def test_jpeg_round_trip():
    rnd = random.Random(4)
    payloads = [bytes(rnd.randrange(256) for _ in range(192 * n)) for n in (1, 2, 9)] + [b"\xff" * 384, b"\xff\x00" * 96, b"\x00" * 192]
    files = jpeg.encode(payloads)
    for p, m, pictures in zip(payloads, files, jpeg.thumbnails(files)):
        assert b"".join(v.tobytes() for _, _, v in pictures) == p
        (parsed,) = jpeg.parse(m)
        assert (parsed.width, parsed.height) == (8 * 192, 8 * len(p) // 192)
    assert files == [jpeg.encode([p])[0] for p in payloads]
    big = b"ab" * (96 * jpeg.MOST_BLOCKS) + b" " * 192
    assert len(jpeg.parse(jpeg.encode([big])[0])) == 2
    assert jpeg.encode([]) == [] and media.pad(b"") == b" " * 192 and len(media.pad(b"x" * 192)) == 192


def colour_jpeg():
    """A 32x16 picture of two MCUs, 4:2:0, with AC coefficients and no restart markers, written bit by bit."""
    dc = jpeg.huffman_codes(jpeg.DC_COUNTS, jpeg.DC_SYMBOLS)
    counts, symbols = [0, 2, 1] + [0] * 13, [0x00, 0x01, 0xF0]
    ac = jpeg.huffman_codes(counts, symbols)
    bits, last = [], [0, 0, 0]

    def put(code, n):
        bits.extend(code >> i & 1 for i in range(n - 1, -1, -1))

    def block(c, level, waves):
        d, last[c] = level - last[c], level
        size = abs(d).bit_length()
        put(*dc[size])
        put(d if d >= 0 else d + (1 << size) - 1, size)
        if waves:
            put(*ac[0xF0])
            put(*ac[0x01])
            put(1, 1)
        put(*ac[0x00])

    levels = [[10, -20, 30, 40], [-5, 0, 7, 90]]
    for four in levels:
        for v in four:
            block(0, v, v > 0)
        block(1, 3, True)
        block(2, -3, False)
    bits += [1] * (-len(bits) % 8)
    scan = bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    table = lambda kind, c, s: jpeg._segment(0xC4, bytes([kind, *c, *s]))
    frame = jpeg._segment(0xC0, bytes([8, 0, 16, 0, 32, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    start = jpeg._segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    return b"\xff\xd8" + jpeg._segment(0xDB, bytes([0, 8] + [1] * 63)) + frame + table(0, jpeg.DC_COUNTS, jpeg.DC_SYMBOLS) + table(0x10, counts, symbols) + start + scan + b"\xff\xd9", levels


def test_jpeg_of_other_writers():
    data, levels = colour_jpeg()
    ((width, height, thumb),) = jpeg.thumbnails([data])[0]
    a, b = levels
    want = [[a[0], a[1], b[0], b[1]], [a[2], a[3], b[2], b[3]]]
    assert (width, height) == (32, 16) and (thumb.astype(int) - 128).tolist() == want
    with pytest.raises(ValueError):
        jpeg.thumbnails([b"not a picture"])


def brute_phrases(sample, text):
    n = i = 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in sample:
            k += 1
        i += max(k - 1, 1)
        n += 1
    return n


@settings(max_examples=80, deadline=None)
@given(st.text("abc", min_size=1, max_size=40), st.lists(st.text("abcd", max_size=60), min_size=1, max_size=5), st.sampled_from([1, 2, 7, 2048]))
def test_cross_parsing(sample, texts, piece):
    """The phrases are those of one greedy parse, wherever the text is cut."""
    p = language_id.Parser([("x", sample), ("y", "bca" * 5)])
    whole, language_id.PIECE = language_id.PIECE, piece
    try:
        got = p.phrases([p.codes(t) for t in texts])
    finally:
        language_id.PIECE = whole
    assert got[:, 0].tolist() == [brute_phrases(sample, t) for t in texts]
    assert got[:, 1].tolist() == [brute_phrases("bca" * 5, t) for t in texts]


def test_long_text_of_one_phrase():
    rng = np.random.default_rng(5)
    sample = "".join("abcdefgh"[i] for i in rng.integers(0, 8, 12_000))
    p = language_id.Parser([("x", sample), ("y", "gfedcbah" * 40)])
    texts = [sample[50:4550], sample[-9000:], sample[:5000] + "z" + sample[2000:8000], "h" * 7000]
    assert p.phrases([p.codes(t) for t in texts])[:, 0].tolist() == [1, 1, 3, brute_phrases(sample, texts[3])]


def test_large_alphabets_stay_small():
    """Three large alphabets and many small ones: the transitions take room by their number, not by states times letters."""
    rng = np.random.default_rng(6)
    draw = lambda first, size, n: "".join(chr(first + int(i)) for i in rng.zipf(1.3, n) % size)
    samples = [("zh", draw(0x4E00, 5000, 20_000)), ("ja", draw(0x5000, 3000, 20_000)), ("ko", draw(0xAC00, 2000, 20_000))]
    samples += [(f"l{k}", draw(97, 26, 2_000)) for k in range(40)]
    p = language_id.Parser(samples)
    assert p.base.nbytes + p.owner.nbytes + p.to.nbytes + p.begin.nbytes < 60 * sum(len(t) for _, t in samples)
    assert p.predict([samples[0][1][7:300], samples[2][1][:99]])[0] == ["zh", "ko"]
    assert p.phrases([p.codes(samples[1][1])])[0, 1] == 1


def test_language_edges():
    p = language_id.Parser([("de", "der hund und die katze " * 20), ("en", "the dog and the cat " * 20)])
    lang, score = p.predict([None, "", "12 !?", "the dog", "der hund", "世界"])
    assert lang[:5] == ["und", "und", "und", "en", "de"] and lang[5] in ("de", "en") and ((score >= 0) & (score <= 1)).all()
    assert language_id.Parser([]).predict(["the dog"])[0] == ["und"]


def brute_likelihood(m, seq):
    total = 0.0
    k = len(m.start)
    import itertools

    for path in itertools.product(range(k), repeat=len(seq)):
        p = m.start[path[0]] * m.emit[seq[0], path[0]]
        for t in range(1, len(seq)):
            p *= m.move[path[t - 1], path[t]] * m.emit[seq[t], path[t]]
        total += p
    return np.log(total)


def test_hmm():
    m = hmm.Hmm.random(3, np.ones(4) / 4)
    seqs = [[0, 1, 2, 3, 1], [2], [3, 3, 0]]
    flat, starts = np.concatenate(seqs), np.array([0, 5, 6, 9])
    assert hmm.forward(m, flat, starts) == pytest.approx([brute_likelihood(m, s) for s in seqs])
    before = -1e9
    for _ in range(8):
        c = hmm.Counts.zero(3, 4)
        hmm.baum_welch(m, flat, starts, c)
        assert c.start.sum() == pytest.approx(3) and c.move.sum() == pytest.approx(6) and c.emit.sum() == pytest.approx(9)
        assert c.log_likelihood >= before - 1e-6
        before = c.log_likelihood
        m = c.model(np.zeros(4), prior=0.0)
    assert hmm.forward(m, flat[:0], np.array([0])).tolist() == []


def test_pair_counts():
    """Counted pairs give what sequences of two symbols, and first symbols what sequences of one, give one by one."""
    m, rng = hmm.Hmm.random(3, np.ones(5) / 5), np.random.default_rng(3)
    pairs = rng.integers(0, 5, (40, 2))
    joint = m.start[:, None] * m.move
    got, want = hmm.Counts.zero(3, 5), hmm.Counts.zero(3, 5)
    u, n = np.unique(pairs, axis=0, return_counts=True)
    hmm.pair_counts(m, joint, u[:, 0], u[:, 1], n, got)
    assert not got.start.any()
    hmm.baum_welch(m, pairs.ravel(), np.arange(41) * 2, want)
    first = hmm.Counts.zero(3, 5)
    hmm.baum_welch(m, pairs[:, 0].copy(), np.arange(41), first)
    u, n = np.unique(pairs[:, 0], return_counts=True)
    hmm.pair_counts(m, joint, np.full(len(u), -1), u, n, got)
    assert got.start == pytest.approx(first.start) and got.move == pytest.approx(want.move)
    assert got.emit == pytest.approx(want.emit + first.emit) and got.log_likelihood == pytest.approx(want.log_likelihood + first.log_likelihood)


def test_quality_features():
    raw = quality.features(pa.array(ODD))
    assert np.isfinite(raw).all() and (raw[[0, 1, 2, 9]] == 0).all()
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, raw.shape[1]))
    y = (x[:, 3] > 0).astype(int)
    m = quality.fit(x, y)
    assert ((m.score(x) >= 0.5) == y).mean() > 0.97
    assert (quality.fit(x, np.ones(300)).score(x) >= 0.5).all() and (quality.fit(x, np.zeros(300)).score(x) < 0.5).all()


def test_toxicity():
    lexicon = toxicity.Lexicon({" idiot ": 5.0, " wort": 4.0, " trash ": 4.0}, ("trash can",), slope=2.0, shift=-4.0)
    a = lexicon.automaton()
    d = lambda x: toxicity.density(a, x)
    assert d("You 1D10T") == d("you idiot") == d("уоu ｉｄｉоt") > 4
    assert d("worthless") == pytest.approx(d("wort")) and d("sworth") == 0 and d(None) == d("") == 0
    assert d("the trash can") == 0 < d("trash")
    assert d("idiot " + "word " * 500) < d("idiot")
    assert toxicity.Lexicon().automaton() is not None and toxicity.density(toxicity.Lexicon(exceptions=()).automaton(), "x") == 0


def test_bradley_terry_against_gradient_descent():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 5))
    label = (x[:, 0] - x[:, 1] + rng.normal(size=40) > 0).astype(int)
    win, lose = quality.preferences(label)
    assert set(win) == set(np.flatnonzero(label == 1)) and set(lose) == set(np.flatnonzero(label == 0))
    few_bad = np.array([0] + [1] * 500)
    assert set(quality.preferences(few_bad)[0]) == set(range(1, 501))
    w = np.zeros(5)
    for _ in range(20_000):
        grad = -quality.RIDGE * w
        d = x[win] - x[lose]
        w = w + 0.5 * (grad + (d / (1 + np.exp(d @ w))[:, None]).mean(0))
    quality.PAIRS_AT_ONCE, whole = 7, quality.PAIRS_AT_ONCE
    try:
        got = quality.bradley_terry(x, win, lose)
    finally:
        quality.PAIRS_AT_ONCE = whole
    assert got == pytest.approx(w, abs=1e-3)


def naive_density(lexicon, text):
    """Every pattern and exception looked for at every place."""
    folded, n = toxicity.fold(text or "")
    phrases = [f" {toxicity.fold(x)[0].strip()} " for x in lexicon.exceptions]
    spans = [(i, i + len(p) - 1) for p in phrases for i in range(len(folded)) if folded.startswith(p, i)]
    total = 0.0
    for i in range(len(folded)):
        w = [w for p, w in lexicon.weight.items() if folded.startswith(p, i)]
        if w and not any(a <= i < b for a, b in spans):
            total += max(w)
    return total / (1 + np.log1p(n / 200))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["b4d", "bad", "badly", "egg", "eggs", "not", "a", "ß", "1", "еgg", "\n", "bad.egg", "not bad"]), max_size=25), st.sampled_from([" ", "  ", "-"]))
def test_lexicon_against_a_naive_scan(some, gap):
    lexicon = toxicity.Lexicon({" bad ": 2.0, " bad": 1.5, " egg ": 3.0, " eggs ": 1.0, " egg": 4.0}, ("not bad", "bad egg", "bad egg bad", "a"))
    text = gap.join(some)
    assert toxicity.density(lexicon.automaton(), text) == pytest.approx(naive_density(lexicon, text))


def test_evidence_and_near_copies():
    assert toxicity.choose([(" x ", 40, 0), (" y ", 40, 3), (" z ", 3, 0), (" w ", 5, 400)], 100, 1000).keys() == {" x "}
    rng = np.random.default_rng(1)
    sig = rng.integers(0, 1 << 16, (9, 64)).astype(np.uint16)
    sig[3], sig[5] = sig[1], sig[1]
    sig[5, :20] = 0
    sig[8, 40:] = sig[1, 40:]
    assert toxicity.near_copies(sig).tolist() == [0, 1, 2, 1, 4, 1, 6, 7, 8]


def test_html():
    model = html_extract.train(html_extract.labelled_pages(250))

    def text(x):
        page = html_extract.Page(x)
        forest = html_extract.Forest([page])
        g = model.marginals(forest)
        return "\n".join(t for n, t in page.blocks if g[n] > 0.5)

    story = "<p>The river turned over the stone.  It &lt;was&gt; caf&eacute;\nlight&amp;more.</p>"
    page = f'<html><body><nav><ul><li><a href="/x">Home</a></li></ul></nav><div class="ad">Buy this now.</div><article><h1>Title of it</h1>{story}<p><b>One two three.<br><p>Four five six.</p><script>var t="</p>";</script></article><footer>&copy; us</footer>'
    assert text(page) == "Title of it\nThe river turned over the stone. It <was> café light&more.\nOne two three.\nFour five six."
    for odd in ("", "<", "<!-- x", "<p title=\"a>b\">", "<div " * 50, "a < b", "</p></div>", "<script>", "<table><tr><td>x<tr><td>y</table>"):
        text(odd)


STORY = "<h1>Title</h1><p>One two three.</p><p>Four five.</p>"


@pytest.mark.parametrize(
    ("source", "texts"),
    [
        (f"<html><head><title>T</title><article>{STORY}</article></html>", ["Title", "One two three.", "Four five."]),
        (f"<head><meta charset=x><script>a='<div>b</div>'</script><template><p>t</p></template>\n<style>p</style>{STORY}", ["Title", "One two three.", "Four five."]),
        ("<head><title>T</title> Bare text", ["Bare text"]),
        ("<head><title>T</title><noscript><p>n</p></noscript></head>x", ["x"]),
        ("<head><template><body>x", ["x"]),
        ("<div><p>One <svg><path></p><p>Two</p></div>", ["One", "Two"]),
        ("<article><svg><path d=x><p>One</p></article><p>Two</p>", ["One", "Two"]),
        ("<article><svg><foreignObject><p>in</p></foreignObject></svg><p>One</p></article>", ["One"]),
        *[(f"<article><div>One <{t}>in</div><p>Two</p></article><p>Three</p>", ["One", "Two", "Three"]) for t in ("svg", "button", "select", "video", "object")],
        *[(f"<article><{t}><div>in</div><p>in</{t}><p>One</p></article>", ["One"]) for t in ("button", "video", "object", "canvas")],
        ("<div><button>a<button>b</button><p>One</p></div>", ["One"]),
        ("<div><object><script>'</div>'</script>in</object>One</div>", ["One"]),
    ],
)
def test_html_open_elements(source, texts):
    """A head or a dropped element that is left open ends where HTML ends it, and swallows no more."""
    assert [t for _, t in html_extract.Page(source).blocks] == texts


def test_labels_are_for_training_pages():
    """A page's own data-y attribute is an attribute like any other."""
    for odd in ('<p data-y="x1">One</p>', "<p data-y>One</p>", '<p data-y="1">One</p>', "<p data-y=9999999999999999999999>One</p>"):
        assert html_extract.Page(odd).blocks == [(1, "One")] and html_extract.Page(odd).label is None
    assert html_extract.Page('<p data-y="1">a<p data-y=x>b', labelled=True).label == [None, 1, None]


@pytest.mark.parametrize("source", ["<div>" * 100_000 + "x", "<div>" * 50_000 + "</p>" * 100_000, "<li><ul>" + "<div>" * 50_000 + "<li>x</li>" * 50_000, "<object>" * 50_000 + "</p>" * 50_000, "<svg>" + "<style>" * 50_000, "<a '" * 50_001])
def test_odd_pages_take_linear_time(source):
    model = html_extract.train(html_extract.labelled_pages(20))
    began = time.process_time()
    assert len(model.marginals(html_extract.Forest([html_extract.Page(source)]))) >= 1
    assert time.process_time() - began < 20


def naive_dc(data):
    """Dimensions and DC luminance of a grey picture by the standard's own loop, a bit at a time."""
    i, tables, interval = 2, {}, 0
    while data[i + 1] != 0xDA:
        size = int.from_bytes(data[i + 2 : i + 4], "big")
        body, marker = data[i + 4 : i + 2 + size], data[i + 1]
        if marker == 0xC4:
            code, k, codes = 0, 17, {}
            for length in range(1, 17):
                for _ in range(body[length]):
                    codes[length, code] = body[k]
                    code, k = code + 1, k + 1
                code *= 2
            tables[body[0]] = codes
        elif marker == 0xC0:
            high, wide = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        elif marker == 0xDB:
            step = body[1]
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        i += 2 + size
    i += 2 + int.from_bytes(data[i + 2 : i + 4], "big")
    at, bits = i, []

    def fill():
        nonlocal at
        byte = data[at]
        at += 2 if byte == 255 else 1
        bits.extend(byte >> k & 1 for k in range(7, -1, -1))

    def take(n):
        while len(bits) < n:
            fill()
        value = 0
        for _ in range(n):
            value = value * 2 + bits.pop(0)
        return value

    def symbol(codes):
        length = code = 0
        while True:
            code, length = code * 2 + take(1), length + 1
            if (length, code) in codes:
                return codes[length, code]

    out, level = [], 0
    for k in range(high // 8 * (wide // 8)):
        if interval and k and k % interval == 0:
            bits.clear()
            assert data[at] == 255 and data[at + 1] == 0xD0 + (k // interval - 1) % 8
            at, level = at + 2, 0
        n = symbol(tables[0])
        v = take(n)
        level += v if n == 0 or v >> (n - 1) else v - (1 << n) + 1
        assert symbol(tables[16]) == 0
        out.append(level * step // 8 + 128)
    return wide, high, bytes(out), data[at:]


def test_jpeg_by_an_independent_decoder():
    rng = np.random.default_rng(2)
    for payload in (b" " * 192, bytes(range(256)) * 3, rng.integers(0, 256, 192 * 11, dtype=np.uint8).tobytes(), b"\xff\x00" * 192):
        (data,) = jpeg.encode([payload])
        assert naive_dc(data) == (8 * 192, 8 * len(payload) // 192, payload, b"\xff\xd9")
        ((width, height, thumb),) = jpeg.thumbnails([data])[0]
        assert (width, height, thumb.tobytes()) == naive_dc(data)[:3]


def test_exact_marginals():
    model = html_extract.train(html_extract.labelled_pages(60))
    page = html_extract.Page("<body><div><p>One two.</p><p class=ad>x</p></div><footer>y</footer></body>")
    f = html_extract.Forest([page])
    unary = model.weight[f.features()].sum(1)
    n, total, on = len(unary), 0.0, np.zeros(len(unary))
    for state in range(1 << n):
        y = [state >> i & 1 for i in range(n)]
        w = np.exp(sum(unary[i] * y[i] for i in range(n))) * np.prod([model.edge[y[f.parent[i]], y[i]] for i in range(n) if f.parent[i] >= 0])
        total += w
        on += w * np.array(y)
    assert model.marginals(f) == pytest.approx(on / total)


def test_sha_of_nothing(tokenizer):
    assert hashlib.sha256(tokenizer.encode("")).hexdigest() == hashlib.sha256(b"").hexdigest()


def test_lexicon_generalises(spark):
    """3 % of labels flipped, a passage that toxic documents quote: the planted words and no other, found again on rows not learned from."""
    rng = random.Random(12)
    planted = [f"vile{k}x" for k in "abcdefghjkmn"]
    common = [f"w{int(rng.paretovariate(0.7))}" for _ in range(60_000)]
    passage = " ".join(f"quoted{k}" for k in range(60))
    rows, truth = [], {}
    for i in range(2_400):
        words = rng.sample(common, rng.randrange(40, 160))
        truth[i] = int(rng.random() < 0.12)
        if truth[i]:
            for w in rng.sample(planted, rng.randrange(2, 5)):
                words.insert(rng.randrange(len(words)), w)
            if rng.random() < 0.1:
                words.insert(len(words) // 2, passage)
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    given = spark.createDataFrame([(i, y ^ int(rng.random() < 0.03)) for i, y in truth.items() if i < 1_600], "doc_id long, toxic int")
    model = toxicity.learn(frame, given)
    assert {t.strip() for t in model.weight} - {"vile"} <= set(planted) and len(model.weight) >= 1
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(frame, model).collect()}
    recall = lambda of: sum(got[i] for i in of if truth[i]) / sum(truth[i] for i in of)
    assert recall(range(1_600, 2_400)) > 0.5 and abs(recall(range(1_600)) - recall(range(1_600, 2_400))) < 0.05
    assert not any(got[i] for i, y in truth.items() if not y)
