"""Whitening, spelling variants and language-model scores against brute force."""

import math

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"


def brute_whitening(vectors, k=32):
    """{row: (deviation, whitened)} and (explained, e) of the valid vectors, by an eigen-decomposition of the exact covariance."""
    x = {i: [math.floor(64 * float(c)) + 1000000 for c in v] for i, v in enumerate(vectors) if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)}
    n, d = len(x), len(next(iter(x.values())))
    s = [sum(v[j] for v in x.values()) for j in range(d)]
    y = np.array([[n * v[j] - s[j] for j in range(d)] for v in x.values()], float) / n
    e, vec = np.linalg.eigh(y.T @ y / n)
    e, vec = e[::-1][:k], vec[:, ::-1][:, :k]
    dev = {i: sum((n * v[j] - s[j]) ** 2 for j in range(d)) for i, v in x.items()}
    return dict(zip(x, y @ vec / np.sqrt(e), strict=True)), dev, e / np.trace(y.T @ y / n), n


def test_whitening(spark):
    from quarry.llm.op11_whiten import whitening

    rng = np.random.default_rng(1)
    mix = rng.normal(size=(7, 7))
    vectors = (rng.normal(size=(300, 7)) @ mix).round(3).tolist()
    vectors += [vectors[5]] * 150 + [None, [], [1.0, None] + [0.0] * 5, [float("nan")] * 7, [float("inf")] + [0.0] * 6, [1e30] + [0.0] * 6, [1.0, 2.0]]
    rows = [(i if i != 9 else None, v, "clash", 1) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, d string, n int").repartition(30)
    got = whitening(df, 5).collect()
    # the vector with 1e30 and the short one have no row
    kept = [v if i < 450 else None for i, v in enumerate(vectors)]
    want, dev, share, n = brute_whitening(kept, 5)
    assert len(got) == 450 * 5 and {r.n for r in got} == {n}
    by = {(r.vec_id, r.component): r for r in got}
    for c in range(1, 6):
        sign = np.sign(by[3, c].whitened * want[3][c - 1])
        for i in range(450):
            r = by[i if i != 9 else None, c]
            assert r.deviation == dev[i] and abs(r.whitened * sign - want[i][c - 1]) < 1e-8
            assert abs(r.explained / share[c - 1] - 1) < 1e-9 and r.identity_error < 1e-9


def test_whitening_edges(spark):
    from quarry.llm.op11_whiten import whitening

    schema = "vec_id bigint, embedding array<float>"
    assert whitening(spark.createDataFrame([], schema)).count() == 0
    assert whitening(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    assert whitening(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).count() == 0  # no variance at all
    line = whitening(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], schema)).collect()
    assert len(line) == 9 and {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-12
    huge = [(i, [2.0**50 * (i % 5), float(i)]) for i in range(40)]  # n * x leaves 64 bits
    _, dev, _, n = brute_whitening([v for _, v in huge])
    got = whitening(spark.createDataFrame(huge, "vec_id bigint, embedding array<double>"), 1).collect()
    assert all(int(r.deviation) == dev[r.vec_id] for r in got) and n == 40


@pytest.mark.parametrize("d", [1, 2, 5, 8, 33])
def test_jacobi(d):
    from quarry.llm.op11_whiten import jacobi

    rng = np.random.default_rng(d)
    a = np.linalg.qr(rng.normal(size=(60, d)) * np.logspace(0, -9, d), mode="r")
    sigma, v = jacobi(a)
    assert np.allclose(sigma, np.linalg.svd(a)[1], rtol=1e-9, atol=0)
    assert np.allclose(v.T @ v, np.eye(d), atol=1e-12)


def test_whitening_query(spark):
    from quarry.llm.op11_whiten import op11_embedding_whitening

    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ids = list(vectors)
    want, dev, share, n = brute_whitening([vectors[i] for i in ids])
    got = op11_embedding_whitening(spark, SF)
    assert dict(got.dtypes)["deviation"] == "bigint"
    by = {(r.vec_id, r.component): r for r in got.collect()}
    assert len(by) == len(want) * 32
    for c in range(1, 33):
        sign = np.sign(by[ids[0], c].whitened * want[0][c - 1])
        assert all(by[ids[i], c].deviation == dev[i] and abs(by[ids[i], c].whitened * sign - want[i][c - 1]) < 1e-6 for i in want)


def brute_variants(counts):
    """The result rows of words with counts, from all single edits of each word."""
    alphabet = {c for w in counts for c in w}
    near = {}
    for w in counts:
        made = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + k :] for i in range(len(w) + 1) for c in alphabet for k in (0, 1)}
        near[w] = (made & counts.keys()) - {w}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= 5 * n:
            form[w] = best
    out = set()
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), counts.get(form.get(w))))
    return out


def brute_words(docs):
    import re
    import zlib
    from collections import Counter

    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


@pytest.mark.parametrize("pairs", [4096, 3])
def test_spelling_variants(spark, pairs):
    import random

    from quarry.llm.op12_spelling import spelling_variants

    rng = random.Random(4)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(6, 9))) for _ in range(250)}
    words |= {"prefix" + "".join(rng.choice("xyz") for _ in range(rng.randrange(1, 5))) for _ in range(60)} | {"q" * 3000, "q" * 3001, "r" + "q" * 3000, "aaaaaa", "aaaaaaa", "aaaaaaaa", "ÀÀàààà", "àÀàààà"}
    counts = {w: rng.choice([5, 6, 30, 31, 200, 1100, 6000]) for w in words}
    rows = [(w, n, "clash") for w, n in counts.items()] + [(None, 9, "x")]
    got = spelling_variants(spark.createDataFrame(rows, "word string, n bigint, k string"), pairs).collect()
    assert {tuple(r) for r in got} == brute_variants(counts) and len(got) == len(counts)
    assert spelling_variants(spark.createDataFrame([], "word string, n bigint")).count() == 0


def test_word_counts(spark):
    from quarry.llm.op12_spelling import word_counts

    texts = [None, "", "12 !?", "Straße straße STRASSE x" * 9, "ÀÉÿ×÷aa " * 7, "letters" * 4000 + " ends", "Ωletters letters日letters", "é", "plain words " * 300] * 3
    docs = [(i if i != 5 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id bigint, text string, n int, word string")
    got = word_counts(df, 199).collect()
    assert {r.word: r.n for r in got} == brute_words(docs) and len(got) > 3


def test_spelling_query(spark):
    from quarry.llm.op12_spelling import op12_spelling_variants

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = op12_spelling_variants(spark, SF).collect()
    want = brute_variants(brute_words(docs))
    assert {tuple(r) for r in got} == want and sum(x[1] is not None for x in want) > 5


def brute_ctw(texts, learn, depth=5):
    """log10 probability of each text, node by node from the definition."""
    from collections import defaultdict

    def steps(text):
        b = bytes(x + 32 if 65 <= x < 91 else x for x in text.encode()) + b"\xff"
        padded = b"\xff" * depth + b
        for i, x in enumerate(b):
            context = padded[i : i + depth][::-1]
            for k in range(8):
                yield context, (256 | x) >> (8 - k), (x >> (7 - k)) & 1

    n = defaultdict(lambda: [0, 0])
    for text, on in zip(texts, learn, strict=True):
        for context, bits, x in steps(text) if on else ():
            for d in range(depth + 1):
                n[context[:d], bits][x] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    mixed, below = {}, defaultdict(float)
    for d in range(depth, -1, -1):
        for (context, bits), c in n.items():
            if len(context) == d:
                own = kt(*c)
                mixed[context, bits] = own if d == depth else math.log(0.5) + np.logaddexp(own, below[context, bits])
                if d:
                    below[context[:-1], bits] += mixed[context, bits]

    def one(context, bits):
        """P(1): recursion from the root; the children's product is their mixtures'."""
        def at(d):
            a, b = n.get((context[:d], bits), (0, 0))
            p = (b + 0.5) / (a + b + 1)
            if d == depth or (context[: d + 1], bits) not in n:
                return p
            w = 1 / (1 + math.exp(min(below[context[:d], bits] - kt(a, b), 700)))
            return w * p + (1 - w) * at(d + 1)

        return at(0)

    return [sum(math.log10(p if x else 1 - p) for context, bits, x in steps(t) for p in [one(context, bits)]) for t in texts]


def brute_base(texts, learn):
    import re
    from collections import Counter

    toks = [[*(re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[^\x20\x09-\x0d]+", t)), None] for t in texts]
    c = Counter(w for t, on in zip(toks, learn, strict=True) if on for w in t)
    n, v = sum(c.values()), len(c)
    return [(len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) for t in toks]


@pytest.mark.parametrize("small", [False, True])
def test_lm_scores(spark, small, monkeypatch):
    import random

    from pyspark.sql import functions as F

    from quarry.llm import op13_ctw

    rng = random.Random(2)
    words = ["the", "THE", "then", "é", "日本", "a", "over", "x" * 30]
    texts = [None, "", " \n\t ", "the", "The the\x0bthe"] + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(40)] + ["long word " * 500]
    texts += texts[5:9]
    held = [i % 4 == 1 for i in range(len(texts))]
    rows = [(i if i != 6 else None, t, h, 1.5, "x") for i, (t, h) in enumerate(zip(texts, held, strict=True))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, out boolean, value double, token string").repartition(3)
    if small:  # several blocks, groups and slices; plain functions are shipped with what they read
        monkeypatch.setattr(op13_ctw, "BLOCK", 300)
    got = {r.doc_id: r for r in op13_ctw.lm_scores(df, F.col("out")).collect()}
    clean = [t or "" for t in texts]
    learn = [not h for h in held]
    base, score = brute_base(clean, learn), brute_ctw(clean, learn)
    assert len(got) == len(texts)
    for i in range(len(texts)):
        r = got[i if i != 6 else None]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (*base[i][:3], held[i])
        assert abs(r.base_score - base[i][3]) < 1e-9 * max(1, -base[i][3]) and abs(r.score - score[i]) < 1e-7 * max(1, -score[i])
        assert abs(r.bits_per_byte + r.score / math.log10(2) / (len(clean[i].encode()) + 1)) < 1e-9


def test_lm_empty(spark):
    from pyspark.sql import functions as F

    from quarry.llm.op13_ctw import lm_scores

    assert lm_scores(spark.createDataFrame([], "doc_id bigint, text string"), F.lit(False)).count() == 0
    r = lm_scores(spark.createDataFrame([(1, "ab")], "doc_id bigint, text string"), F.lit(True)).first()
    assert (r.train_tokens, r.n_known, r.base_score) == (0, 0, 0.0) and abs(r.bits_per_byte - 8) < 1e-9


def test_lm_blocks():
    import pyarrow as pa

    from quarry.llm import op13_ctw

    rng = np.random.default_rng(0)
    data = rng.integers(97, 103, 4000).astype(np.uint8)
    offsets = np.array([0, 0, 1000, 1003, 1003, 4000, 4000])
    key, row = op13_ctw.grams(data, offsets, 0, 6)
    assert len(key) == 4006 and np.bincount(row).tolist() == [1, 1001, 4, 1, 2998, 1]
    dic, row = op13_ctw.tokens(data, offsets, 0, 6)
    assert [x.as_py() for x in dic][-6:] == [b""] * 6 and len(row) == 9
    gram, n = np.unique(key.astype(np.int64), return_counts=True)
    every = (np.repeat(np.unique(gram >> 8), 256) << 8) + np.tile(np.arange(256), len(np.unique(gram >> 8)))
    counts = np.zeros(len(every), np.int64)
    counts[np.searchsorted(every, gram)] = n
    total = np.zeros(len(every))
    for k in range(8):
        bit = op13_ctw._Bit(every, counts, k)
        keys = bit.levels[-1][0]
        total += bit.predicted(keys, np.zeros(len(keys)), np.ones(len(keys)), np.full(len(keys), 0.5))
    assert np.allclose((10**total).reshape(-1, 256).sum(1), 1)
    assert isinstance(dic, pa.DictionaryArray)


def test_lm_query(spark):
    """Held-out texts, of which training knows nothing, take under a third of their bytes."""
    from quarry.llm.op13_ctw import op13_lm_scoring

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op13_lm_scoring(spark, SF).collect()
    held = [r for r in rows if r.held_out]
    size = sum(len(docs[r.doc_id].encode()) + 1 for r in held)
    assert len(rows) == len(docs) and held and -sum(r.score for r in held) / math.log10(2) / size < 2.6
    by = {r.doc_id: r for r in rows}
    for i, want in zip(docs, brute_base(list(docs.values()), [not by[i].held_out for i in docs]), strict=True):
        assert (by[i].n_tokens, by[i].n_known, by[i].train_tokens) == want[:3] and abs(by[i].base_score - want[3]) < 1e-9 * -want[3]


MARKUP = [
    ("<form id=f><article><p>text</p></article></form>", "text"),
    ("<article><p data-x=it's>lost</p><p>it's kept</p></article>", "lost\nit's kept"),
    ('<article><p title="a"b">lost text</p></article>', "lost text"),
    ("<article><p>a <button><div>Buy now</div></button> b</p></article>", "a b"),
    ("<article><p>x <select><option>one<option>two</select> y</p><form>f <p>g</p></form>z</article>", "x y\nz"),
    ("<article><p>a <menu><li>i</li></menu> b</article>", "a b"),
    ("<article><p>a<table><tr><td><p>c</p></td></tr></table>d</article>", "a\nc\nd"),
    ("<article class=x title=\"class=ad\">k</article><p class='ad'>no", "k"),
    ("<article><div class='ad'><p>no</div><p>yes &amp; <b>bold</b>\n  text<nav>n<p>m</nav></article>", "yes & bold text"),
    ("<article><a href=/x?a=b&quot;>link</a> <img alt='>'> <input value=\"a>b\">end</article>", "link end"),
    ("<p>no mark</p><footer>f</footer>", "no mark"),
]


@pytest.mark.parametrize("source,text", MARKUP)
def test_main_text_of_markup(source, text):
    from quarry.llm.op5_html import INSIDE, OTHER, blocks

    found = blocks(source)
    wanted = INSIDE if any(f == INSIDE for _, f in found) else OTHER
    assert "\n".join(t for t, f in found if f == wanted) == text


def test_articles_against_another_parser():
    """Pages made as trees, so that their text is known without parsing."""
    import random

    from quarry.llm.op5_html import INSIDE, blocks

    rng = random.Random(9)
    words = ["one", "two's", "3 < 4", 'say "x"', "é", "a&b"]
    escape = lambda t: t.replace("&", "&amp;").replace("<", "&lt;")
    attributes = lambda: rng.choice(["", " id=a", ' title="a>b"', " data-x=it's", " class='x y'", ' alt = "q"r"', " checked"])
    for _ in range(200):
        html, want = [], []
        for _ in range(rng.randrange(1, 6)):
            text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 5)))
            noise = rng.choice(["", "<button>no</button>", "<select><option>no<option>no</select>", "<script>if (a<b) no()</script>", "<!-- <p>no --> ", "<div class=ad><p>no</div>", "<form><input value='>'><p>no</form>", "<nav>no</nav>"])
            if noise[:4] in ("<div", "<for", "<nav"):  # blocks of their own
                html.append(noise)
                noise = ""
            name = rng.choice(["p", "div", "h2", "li"])
            html.append(f"<{name}{attributes()}>{escape(text)}{noise}" + (f"</{name}>" if name != "p" or rng.random() < 0.5 else ""))
            want.append(" ".join(text.split()))
        page = f"<html><head><title>no</title></head><body><header>no</header><{rng.choice(['div', 'form', 'section'])} class='site'><article{attributes()}>{' '.join(html)}</article></body>"
        assert [t for t, f in blocks(page) if f == INSIDE] == want, page


def test_blocks_are_linear():
    import time

    from quarry.llm.op5_html import blocks

    for source in ("<b>" * 200_000 + "</i>" * 200_000, "<div>" * 400_000, "<p><button>" * 100_000 + "<div>" * 100_000, '<a b="' * 200_000, "<" * 300_000):
        began = time.time()
        blocks(source)
        assert time.time() - began < 30


def test_secrets_in_repeated_scopes():
    """A name bound in thousands of scopes is looked up as often, in linear time, and keeps all its literals."""
    import time

    from quarry.llm.op10_secrets import lexed

    text = "\n".join(f'{{k = "aB3xK9pQ7zLm2T{i:04d}"}}' for i in range(8000)) + "\n" + "{pwd = k}\n" * 40_000
    began = time.time()
    found = lexed(text)
    assert time.time() - began < 20 and len(found) == 8000
    assert len(lexed('k = "aB3xK9pQ7zLm2Ty5"\n{k = "zz9xK9pQ7zLm2Ty5"\npwd = k}\n')) == 1  # the nearest scope


KEY = "aB3xK9pQ7zLm2Ty5"
HEREDOCS = [
    "DB_PWD=$(cat <<EOF\n{}\nEOF\n)", 'DB_PWD="$(cat <<\'EOF\'\n{}\nEOF\n)"', "db_pwd = <<~TEXT\n   {}\n  TEXT\n", "$pwd = <<<EOT\n{}\nEOT;\n", "pwd = <<-EOT\n  {}\n  EOT\nx = 1",
]
QUOTES = ["the dogs ' bone and db_pwd = '{}'", "dogs ' x pwd = '{}' cats ' y", "db = 'x' the dogs ' bone db_pwd: '{}'", '6" pipe, pwd = "{}"', "the cooks' pots, pwd='{}'"]
ABOUT_SECRETS = [
    'password_hint = "the-name-of-your-dog"', 'private = "see-the-docs-for-details"', 'token_type = "Bearer9x8y7z6w5v"', "pwd = A + B", 'A = "Hello, "\nB = "world of words"\nauth_token = A + B',
    "the cooks' pots = 'aB3xK9pQ7zLm2Ty5'", "text = <<EOT\n" + "aB3xK9pQ7zLm2Ty5\nEOT\n", 'A = B + A\nB = A + "x"\npwd = A + B', 'A = "aB3xK9pQ"\nB = "7zLm2Ty5"\ncolour = A + B',
]


def test_secrets_behind_odd_quotes_and_in_heredocs():
    from quarry.llm.op10_secrets import lexed, redact, scan

    for form in HEREDOCS + QUOTES:
        text = form.format(KEY)
        assert [text[a:b] for a, b, _ in lexed(text)] == [KEY], text
        assert KEY not in redact(text, scan(text))
    assert [t for t in ABOUT_SECRETS if lexed(t)] == []


def test_secrets_joined_from_names():
    from quarry.llm.op10_secrets import lexed

    def found(text):
        return {text[a:b] for a, b, _ in lexed(text)}

    assert found('A = "aB3xK9pQ"\nB = "7zLm2Ty5"\npwd = A + B') == {"aB3xK9pQ", "7zLm2Ty5"}
    assert found('$a = "aB3x";\n$b = "K9pQ7z";\n$db_pwd = $a . $b;') == {"aB3x", "K9pQ7z"}
    assert found('a = "aB3x"\nb = a + "K9pQ7z"\nother = "keep this"\npwd = b + "Lm2T"') == {"aB3x", "K9pQ7z", "Lm2T"}
    assert found('a = "aB3x"\nb = a\nc = b\npwd = c + c + c') == {"aB3x"}


def test_joins_quotes_and_heredocs_in_linear_time():
    import time

    from quarry.llm.op10_secrets import lexed

    texts = [
        'A = "' + KEY * 1000 + '"\n' + "pwd = A + A\n" * 50_000, 'c0 = "aB3x"\n' + "".join(f"c{i + 1} = c{i} + c{i}\n" for i in range(3000)) + "pwd = c3000 + c1",
        "x ' y = 'z \"" * 80_000, "pwd = <<E\n" * 100_000, "pwd = <<E\n" * 100_000 + "E\n", "pwd = " + "a + " * 250_000 + "b",
    ]
    for text in texts:
        start = time.time()
        lexed(text)
        assert time.time() - start < 20


def test_decontamination_of_items_with_one_prompt(spark, monkeypatch):
    import random

    from pyspark.sql import types as T

    from quarry.llm import op4_decontam as op4
    from tests.llm.test_llm import brute_overlap

    made = {}
    cut = op4.Stage.cut

    def counted(self, df, name, *rest):
        out = cut(self, df, name, *rest)
        made[name] = out.count()
        return out

    monkeypatch.setattr(op4.Stage, "cut", counted)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(1000)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    frames = lambda docs, items: (
        spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(docs)], schema),
        spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string"),
    )

    prompt = words(10)
    docs, items = [words(20) + prompt + words(20) for _ in range(300)], [words(10) + prompt + words(10) for _ in range(300)]
    want = {(d, i) for d, t in enumerate(docs) for i, x in enumerate(items) if brute_overlap(t, x)}
    got = {(r.doc_id, r.item_id) for r in op4.decontaminate(*frames(docs, items)).collect()}
    assert made["hot"] >= 4 and made["pairs"] < 1000 and got == want

    # items that are leaked, whole or around the prompt, with words replaced
    items = [words(rng.randrange(12)) + prompt + words(rng.randrange(3, 40)) for _ in range(60)]
    docs = []
    for _ in range(6):
        for item in items:
            part = list(item)
            at = next(a for a in range(len(part)) if part[a : a + 10] == prompt)
            a = rng.randrange(at + 1)
            part = part[a : max(a + 13, rng.randrange(at + 10, len(part) + 1))]
            for x in rng.sample(range(len(part)), rng.randrange(len(part) // 5 + 1)):
                part[x] = rng.choice(vocab)
            docs.append(words(rng.randrange(20)) + part + words(rng.randrange(20)))
    docs.append(docs[0])
    want = {(d, i): x for d, t in enumerate(docs) for i, item in enumerate(items) if (x := brute_overlap(t, item))}
    got = {(r.doc_id, r.item_id): (r.n_same, r.n_overlap, -r.first_word) for r in op4.decontaminate(*frames(docs, items)).collect()}
    assert len(want) > 200 and set(got) <= set(want) and len(got) >= 0.97 * len(want), (len(want), len(got))
    assert sum(got[x] == want[x] for x in got) >= 0.98 * len(got)
    monkeypatch.setattr(op4, "HOT", 1 << 60)  # all seeds joined alone
    plain = {(r.doc_id, r.item_id) for r in op4.decontaminate(*frames(docs, items)).collect()}
    print(made, len(want), len(got), len(plain))
    assert len(plain - set(got)) <= 0.01 * len(want)
