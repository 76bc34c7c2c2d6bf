"""Each operator against brute force, an exact round trip or held-out labels."""

from __future__ import annotations

import collections
import hashlib
import html
import io
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from keyloom.llm import bpe, components, exact_dedup, fuzzy_hash, html_extract, minhash, mixing, quality, secrets, toxicity, warc
from keyloom.llm.common import lookup

SMALL, LARGER, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"
needs_data = pytest.mark.skipif(not os.path.exists(SMALL), reason="the driver's tables are not here")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(texts):
    """Components of the exact links, from all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in texts.items()}
    holders = collections.defaultdict(list)
    for i in sorted(sets):
        for s in sets[i]:
            holders[s].append(i)
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in {j for s in sets[i] for j in holders[s] if j < i}:
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in sets}


def near_group(n=160, seed=5):
    """Copies of one text with so many edits that some links are direct, some over others, and some are not there."""
    r = random.Random(seed)
    base = [f"w{r.randrange(400)}" for _ in range(150)]
    out = {}
    for i in range(n):
        w = base[:]
        for _ in range(r.choice((0, 1, 2, 3, 4, 6, 8))):
            w[r.randrange(len(w))] = f"x{r.randrange(30)}"
        out[i] = " ".join(w)
    return out


@pytest.mark.parametrize("limit", [0, 50])
def test_near_copies_of_one_text(spark, monkeypatch, limit):
    monkeypatch.setattr("keyloom.llm.common.HOT_ROWS", limit)
    texts = near_group()
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()}
    assert got == brute_components(texts)
    assert len({c for _, c in got.values()}) > 1


@needs_data
def test_near_duplicates_of_documents(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()}
    assert got == brute_components(texts)


def test_signatures_estimate_likeness():
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 1 << 64, 2000, dtype=np.uint64))
    for likeness in (0.5, 0.75, 0.9):
        shared = int(len(a) * 2 * likeness / (1 + likeness))
        b = np.concatenate([a[:shared], np.unique(r.integers(0, 1 << 64, len(a) - shared, dtype=np.uint64))])
        sig = minhash.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 400)
        assert abs((sig[0] == sig[1]).mean() - likeness) < 0.06


def test_components_of_chains(spark):
    r = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 80)] + [(300, 301), (301, 300), (302, 302)]
    r.shuffle(links)
    got = {x.node: x.label for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 180), 100), 300: 300, 301: 300}


@needs_data
def test_encoding_is_the_library_s():
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(bpe.default_path()), bpe.Vocabulary.load(bpe.default_path())
    r = random.Random(4)
    pool = [chr(c) for c in [*range(0x250), 0x3A3, 0x3C2, 0x130, 0x1E9E, 0x2028, 0x3000, 0x85, 0x301, 0x1F600, 0x4E2D, 0xAC00, 0x1161, 0x200B, 0xFB01, 0x661, 0x212A]]
    texts = ["".join(r.choices(pool, k=r.randrange(60))) for _ in range(400)]
    texts += ["a" * 3000, "!" * 500, "'s't're DON'T <|endoftext|>x<|startoftext|>", "<|ENDOFTEXT|>", "", "\x1c a\x1eb", "ΑΣ Σ"]
    import pyarrow.parquet as pq

    texts += pq.read_table(f"{SMALL}/documents.parquet")["text"].to_pylist()
    for text, (ids, decoded) in zip(texts, bpe.Encoder(own).encode(texts), strict=True):
        want = lib.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert decoded == lib.decode(want, skip_special_tokens=False) == bpe.decode(ids, own)


def test_one_merge_a_round_gives_the_same():
    own = bpe.Vocabulary.load(bpe.default_path())
    some = [w.encode() for w in ("aaaaaaa", "banana", "thththth", "internationalisation", "zzzzzzzzzzzz", "!!!!!")]
    fast, edges = own.merge(some)
    own.in_order = False
    slow, others = own.merge(some)
    assert fast.tolist() == slow.tolist() and edges.tolist() == others.tolist()


@needs_data
def test_toxicity_of_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{n}.parquet") for n in ("documents", "labels"))
    known = {r.doc_id: r.toxic for r in labels.collect()}
    got = [r for r in toxicity.score_documents(docs, labels).collect() if r.held_out and r.doc_id in known]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    hit = sum(r.predicted == 1 and known[r.doc_id] == 1 for r in got)
    assert hit / sum(r.predicted for r in got) > 0.85 and hit / sum(known[r.doc_id] for r in got) > 0.8


def test_misspellings_share_subwords():
    r = random.Random(3)
    syllables = ["ba", "ko", "lu", "me", "ti", "so", "ra", "ne"]
    texts, labels = [], []
    for i in range(400):
        w = ["".join(r.choices(syllables, k=3)) for _ in range(30)]
        if i % 4 == 0:
            w[r.randrange(30)] = r.choice(("horrible", "disgrace", "worthless"))
        texts.append(" ".join(w))
        labels.append(int(i % 4 == 0))
    model = toxicity.train(texts, np.array(labels))
    plain = " ".join("".join(r.choices(syllables, k=3)) for _ in range(29))
    odd = model.probabilities([plain + " horribble", plain + " worthles", plain + " katime"])
    assert min(odd[0], odd[1]) > odd[2]


@pytest.mark.parametrize("rows", [3000, 12])
def test_mix_against_a_queue(spark, rows):
    r = random.Random(rows)
    data = [(i, " ".join(["w"] * r.randrange(0, 40)), r.choices(["a", "b", None, "d", "e"], [20, 2, 2, 1, 1])[0]) for i in range(rows)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4)
    got = {x.doc_id: x for x in mixing.mix_plan(df).collect()}
    sizes = {i: len(words(t)) for i, t, _ in data}
    names = sorted({s for *_, s in data}, key=lambda s: (s is None, s or ""))
    size = {s: sum(sizes[i] for i, _, q in data if q == s) for s in names}
    total = sum(size.values())
    open_, target, left = set(names), {}, float(total)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * size[s]}
        if not full:
            break
        for s in full:
            target[s] = 3.0 * size[s]
            left -= target[s]
        open_ -= full
    target |= {s: level * weight[s] for s in open_}
    place = lambda i: int(hashlib.md5(f"mix{i}".encode()).hexdigest()[:8], 16)
    items = []
    for k, s in enumerate(names):
        queue = sorted((i for i, _, q in data if q == s and sizes[i]), key=lambda i: (place(i), i))
        through = 0
        for turn in range(3):
            for i in queue:
                through += sizes[i]
                items.append((through / target[s], k, place(i), i, turn))
    taken, so_far = collections.Counter(), 0
    for finish, _, _, i, _ in sorted(items):
        so_far += sizes[i]
        if so_far > total or finish > 2:
            break
        taken[i] += sizes[i]
    for i, _, s in data:
        assert (got[i].size, got[i].source_size, got[i].taken) == (sizes[i], size[s], taken[i])
        assert got[i].target == pytest.approx(target[s])
    again = {x.doc_id: x.taken for x in mixing.mix_plan(df.repartition(3)).collect()}
    assert again == {i: x.taken for i, x in got.items()}


def test_secret_kinds():
    body = "A" * 30
    value, check = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, d = divmod(value, 62)
        check = secrets._DIGITS[d] + check
    text = f"é PassWD: 'abc=def' token=x API_key = \"123456\" AKIA{'Z' * 16} AKIAZZ ghp_{body}{check} ghp_{body}000000 {'0a' * 12} 4111 1111 1111 1111 4111 1111 1111 1112 GB82WEST12345698765432"
    got = secrets.Scanner().spans(text)
    kinds = collections.Counter(k for k, *_ in got)
    assert kinds == {"assign": 2, "access": 1, "github": 1, "hex": 1, "card": 1, "iban": 1}
    assert all(text[a:b] == "4111 1111 1111 1111" for k, a, b in got if k == "card")


@needs_data
def test_base_secrets_of_documents(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    patterns = [("assign", secrets.ASSIGN, lambda m: len(m[2]) >= 6), ("access", secrets.ACCESS, lambda m: len(m[0]) >= 20), ("hex", secrets.HEX, lambda m: len(m[0]) >= 24)]
    for r in secrets.scan(docs).collect():
        found = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(patterns) for m in p.finditer(texts[r.doc_id]) if ok(m))
        want = ",".join(f"{patterns[k][0]}:{a}:{b}" for a, k, b in found)
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_edit_distance_and_likeness():
    def plain(a, b):
        line = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            fresh = [i]
            for j, y in enumerate(b, 1):
                fresh.append(min(line[j] + 1, fresh[-1] + 1, line[j - 1] + (x != y)))
            line = fresh
        return line[-1]

    r = random.Random(6)
    pairs = [("".join(r.choices("abc", k=r.randrange(14))), "".join(r.choices("abc", k=r.randrange(14)))) for _ in range(600)]
    assert fuzzy_hash.edit_distances(pairs).tolist() == [plain(a, b) for a, b in pairs]
    text = " ".join(f"w{r.randrange(5000)}" for _ in range(3000)).encode()
    other = " ".join(f"v{r.randrange(5000)}" for _ in range(3000)).encode()
    prints = [fuzzy_hash.fingerprint(np.frombuffer(t, np.uint8)) for t in (text, text[:9000] + b"inserted" + text[9000:], other)]
    near, far = fuzzy_hash.likenesses([(prints[0], prints[1]), (prints[0], prints[2])])
    assert near > 0.9 and far < 0.3


def test_fingerprints_of_repetitive_texts():
    r = random.Random(85)
    for period in range(1, 60):
        unit = " ".join(f"u{r.randrange(1000)}" for _ in range(period))
        text = ((unit + " ") * 9000)[:14000].encode()
        other = some_words(r, 2000)[:7000].encode()
        a, b = (fuzzy_hash.fingerprint(np.frombuffer(t, np.uint8)) for t in (text, text[:9334] + other[:4666]))
        assert len(a.split(":")[1]) >= 6
        assert fuzzy_hash.likenesses([(a, b)])[0] > 0.3


def test_archives_reject_damage():
    good = warc.record_bytes("response", 1, "http://x", b"payload", warc.digest_of(b"payload"), None)
    both = good + warc.record_bytes("revisit", 2, "http://y", b"payload", warc.digest_of(b"payload"), 1)
    assert [(r.headers["WARC-Type"], r.block) for r in warc.read_records(io.BytesIO(both))] == [("response", b"payload"), ("revisit", b"")]
    wrong = warc.record_bytes("response", 1, "http://x", b"payload", warc.digest_of(b"other"), None)
    for bad in (both[:-3], wrong):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(bad)))


def test_wrapper_finds_the_slot(spark):
    page = "<body><div class='top'>Site name</div><div id='c'><div class='x'><p>Share this story</p></div><p>{a}</p><p>{b}</p></div><div class='bottom'>All rights reserved</div></body>"
    r = random.Random(8)
    rows = [(i, f"http://h.example/{i}", page.format(a=f"first {r.random()}", b=f"second {r.random()}")) for i in range(8)]
    got = {x.page_id: x.text for x in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, h in rows:
        assert got[i] == " ".join(re.findall("<p>((?:first|second)[^<]*)</p>", h))


def texts_of(spark, rows):
    return {x.page_id: x.text for x in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def some_words(r, n):
    return " ".join(f"w{r.randrange(10**6)}" for _ in range(n))


def test_template_inside_article_goes_but_not_from_copies(spark):
    page = "<body><article><h1>{t}</h1><div class='x'>Read it first at our place</div><p>{a}</p></article></body>"
    r = random.Random(81)
    texts = [(some_words(r, 4), some_words(r, 30)) for _ in range(6)]
    one = (some_words(r, 4), some_words(r, 60))
    near = [(one[0], f"{one[1]} v{k}") for k in range(8)]
    rows = [(i, f"http://h.example/{i}", page.format(t=t, a=a)) for i, (t, a) in enumerate(near + texts)]
    rows += [(50 + i, f"http://copies.example/{i}", page.format(t=t, a=a)) for i, (t, a) in enumerate(near)]
    got = texts_of(spark, rows)
    assert [got[i] for i in range(14)] == [f"{t} {a}" for t, a in near + texts]
    assert [got[50 + i] for i in range(8)] == [f"{t} Read it first at our place {a}" for t, a in near]


def test_deep_elements_close_themselves():
    deep = "<div>" * 5000 + "<aside>side</aside><p>low</p>" + "</div>" * 5000
    assert html_extract.extract(f"<body><div><article><p>head</p>{deep}<p>tail</p></article></div></body>", None) == "head low tail"
    below = "<div>" * 5000 + "<article>text</article>" + "</div>" * 5000
    assert html_extract.extract(f"<body><p>x</p>{below}</body>", None) == "text"
    bones = html_extract.skeleton(html_extract.parse(deep))
    assert html_extract.match(bones, bones) == {i: i for i in range(len(bones))}


def test_matching_is_exact_at_any_width():
    def brute(a, b):
        kids = [[[i for i in range(len(s)) if s[i][0] == p] for p in range(len(s))] for s in (a, b)]

        def weigh(x, y):
            if a[x][1] != b[y][1]:
                return 0
            line = [0] * (len(kids[1][y]) + 1)
            for u in kids[0][x]:
                fresh = [0]
                for j, v in enumerate(kids[1][y], 1):
                    w = weigh(u, v)
                    fresh.append(max(line[j], fresh[-1], line[j - 1] + w if w else 0))
                line = fresh
            return line[-1] + 1

        return weigh(0, 0)

    def tree(r, n):
        out = [[-1, "#", 0, 0]]
        for _ in range(n):
            out.append([r.randrange(len(out)) if r.random() < 0.5 else 0, r.choice(["div", "p", "ul"]), 0, 0])
        return html_extract.skeleton(html_extract.parse(render(out, 0)))

    def render(s, i):
        below = "".join(render(s, k) for k in range(len(s)) if s[k][0] == i)
        return below if i == 0 else f"<div class={s[i][1]}>{below}</div>"

    def good(a, b, found):
        assert all(a[x][1] == b[y][1] and (x == 0 or found[a[x][0]] == b[y][0]) for x, y in found.items())
        order = sorted(found)
        assert all(found[x] < found[y] for x, y in zip(order, order[1:]))

    r = random.Random(13)
    for k in range(40):
        a, b = tree(r, r.randrange(12 + 40 * (k > 34))), tree(r, r.randrange(12 + 40 * (k > 34)))
        found = html_extract.match(a, b)
        good(a, b, found)
        assert len(found) == brute(a, b)
    # 700 siblings against as many after a gap of 100: a look-ahead of 64 finds none of them
    a = [[-1, "#", 0, 0], *([0, f"div n{i}", 0, 0] for i in range(100, 800))]
    b = [[-1, "#", 0, 0], *([0, f"div n{i}", 0, 0] for i in range(800))]
    assert html_extract.match(a, b) == {0: 0} | {i: i + 100 for i in range(1, 701)}


def test_pages_without_article_keep_their_text(spark):
    page = "<body><div class='top'>Site name</div><div><h1>{t}</h1><div class='text'><p>{a}</p></div><p class='last'>{z}</p></div></body>"
    r = random.Random(83)
    rows = [(i, f"http://h.example/{i}", page.format(t=some_words(r, 3), a=some_words(r, 200), z=some_words(r, 4))) for i in range(8)]
    same = f"<body><h1>{some_words(r, 4)}</h1><div class='text'>{some_words(r, 90)}</div><div class='day'>2024-01-%02d</div></body>"
    rows += [(20 + i, f"http://near.example/{i}", same % i) for i in range(9)]
    # exact copies of one text that share a heading with the reference by chance count once
    chance = "<body><h1>Chance heading</h1><div class='text'>{a}</div></body>"
    bodies = [some_words(r, 50) for _ in range(5)]
    rows += [(40 + i, f"http://chance.example/{i}", chance.format(a=bodies[i > 0])) for i in range(9)]
    rows += [(50 + i, f"http://chance.example/{i}", chance.format(a=bodies[i + 2]).replace("Chance heading", f"Other {i}")) for i in range(3)]
    got = texts_of(spark, rows)
    for i, _, h in rows:
        assert got[i] == " ".join(re.sub("<[^>]*>", " ", h.replace("Site name", "")).split())


def test_references_by_layout(spark):
    page = "<body><div class='top'>Site name here</div><div class='text'><p>{a}</p></div></body>"
    other = "<body><table><tr><td>Shop of the site</td></tr></table><div class='text'><p>{a}</p></div></body>"
    r = random.Random(84)
    rows = [(0, "http://h.example/0", None), (1, "http://h.example/1", "<body><h1>Error 404</h1></body>")]
    rows += [(2 + i, f"http://h.example/{i}", page.format(a=some_words(r, 20))) for i in range(7)]
    rows += [(20 + i, f"http://h.example/{i}", other.format(a=some_words(r, 20))) for i in range(5)]
    rows += [(40 + i, f"http://two.example/{i}", page.format(a=some_words(r, 20))) for i in range(2)]
    got = texts_of(spark, rows)
    assert got[0] == "" and got[1] == "Error 404"
    for i, _, h in rows[2:]:
        assert got[i] == re.search("<p>(.*)</p>", h)[1]


def article_of(page):
    inner = re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", re.search("<article>(.*?)</article>", page, re.DOTALL)[1])
    return " ".join(html.unescape(re.sub("<[^>]*>", "", inner)).split())


@needs_data
def test_wrapper_alone_finds_the_articles(spark):
    """With all elements of pages renamed to neutral ones, what is menu, advert, article or footer follows from the wrapper."""
    pages = spark.read.parquet(f"{MIDDLE}/pages.parquet")
    gold = {r.page_id: article_of(r.html) for r in pages.collect()}
    assert {r.page_id: r.text for r in html_extract.extract_text(pages).collect()} == gold
    plain = pages
    for k, tag in enumerate(("nav", "article", "footer")):
        plain = plain.withColumn("html", F.replace(F.replace("html", F.lit(f"<{tag}>"), F.lit(f"<div class='c{k}'>")), F.lit(f"</{tag}>"), F.lit("</div>")))
    plain = plain.withColumn("html", F.replace("html", F.lit('class="ad"'), F.lit('class="c9"')))
    hosts = collections.defaultdict(list)
    for r in html_extract.extract_text(plain).join(plain.select("page_id", "html"), "page_id").collect():
        hosts[re.sub("^https?://([^/]+).*", r"\1", r.url)].append((r.text == gold[r.page_id], html_extract.extract(r.html, None) == gold[r.page_id]))
    assert not any(without for v in hosts.values() for _, without in v)
    assert sum(all(right for right, _ in v) for v in hosts.values()) >= 0.85 * len(hosts)
    assert all(right for v in hosts.values() if len(v) >= 25 for right, _ in v)


def test_inline_adverts_go_and_other_spans_stay():
    page = "<article><p>one <span class='ad'>BUY <b>now</b></span> two<span class='x'>three <span>four</span> five</span> <a class='share-link' href='#'>tweet</a> <span class=header>six</span></p></article>"
    assert html_extract.extract(page, None) == "one twothree four five six"


def test_noise_elements_go():
    page = (
        "<html><head><title>t</title></head><body><header>Site</header><nav>menu</nav><div class='cookie-notice'>ok?</div><main><article><header><h1>Title</h1></header>"
        "<p>One&#8212;two.<p>Three <i>fo</i>ur<aside>side</aside><form>field<button>go</button></form><div class=\"ad\">buy</div><script>x='<p>no</p>'</script>"
        "<section class='comments'><p>first!</p></section></article></main><div class='sidebar'>more</div><footer>end</footer></body></html>"
    )
    assert html_extract.extract(page, None) == "Title One—two. Three four"


def test_maximisation_finds_the_bad_labeller():
    r = np.random.default_rng(5)
    truth = r.random(4000) < 0.7
    right = [0.9, 0.85, 0.8, 0.5]
    votes = np.stack([np.where(r.random(4000) < p, truth, ~truth) * 2 - 1 for p in right], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    table, share = quality.expectation_maximisation(patterns, counts)
    assert abs(share - 0.7) < 0.06
    assert all(abs(table[k, 1, 1] - p) < 0.06 for k, p in enumerate(right))


@needs_data
def test_quality_keeps_good_documents(spark):
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{n}.parquet") for n in ("documents", "labels"))
    known = {r.doc_id: r.quality for r in labels.collect()}
    got = [r for r in quality.score_quality(docs).collect() if r.doc_id in known]
    good, bad = ([r.kept for r in got if known[r.doc_id] == q] for q in (1, 0))
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.4


@needs_data
def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = toxicity.fit(docs, labels)
    left = {i: r.text for i, r in rows.items() if model.probabilities([r.text])[0] < 0.5}
    first = {}
    for i in sorted(left):
        first.setdefault(left[i], i)
    left = {i: left[i] for i in first.values()}
    left = {i: left[i] for i, (_, c) in brute_components(left).items() if i == c}
    base = spark.createDataFrame([rows[i] for i in left], docs.schema)
    repeats = {r.doc_id: r.taken // r.size for r in mixing.mix_plan(base).collect() if r.size}
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter({i: n for i, n in repeats.items() if n})
    encoder = bpe.Encoder(bpe.Vocabulary.load(bpe.default_path()))
    for r in got:
        ((ids, decoded),) = encoder.encode([left[r.doc_id]])
        assert r.ids == ids.tolist() and r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns


def test_exact_copies_spread_over_partitions(spark):
    df = spark.range(600).selectExpr("id as doc_id", "if(id % 3 = 0, 'copy', concat('own ', id)) as text").repartition(8)
    got = exact_dedup.exact_plan(df, keep="largest").where("group_size > 1").select("keep_id", "group_size").distinct().collect()
    assert [tuple(r) for r in got] == [(597, 200)]
    assert exact_dedup.exact_dedup(df).count() == 401


def slow_fingerprint(data):
    """A fingerprint byte by byte: the window's hash is computed anew at each byte, each chunk's at its end."""
    full, base = (1 << 64) - 1, 0x9E3779B97F4A7C15 | 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & full
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & full
        return x ^ (x >> 31)

    def polynomial(piece):
        return sum((b + 1) * pow(base, k, 1 << 64) for k, b in enumerate(piece)) & full

    def chunks_at(block):
        out, begin = [], 0
        for i in range(len(data)):
            rolled = mix(polynomial(data[max(0, i + 1 - fuzzy_hash.WINDOW) : i + 1])) >> 20
            if rolled % block == block - 1 or i + 1 - begin == 2 * block or i + 1 == len(data):
                out.append(data[begin : i + 1])
                begin = i + 1
        return out

    size = 3
    while size * 48 < len(data):
        size *= 2
    if not data:
        return f"{size}::"
    while size > 3 and len(chunks_at(size)) < 24 and len(chunks_at(size // 2)) <= 64:
        size //= 2
    digits = fuzzy_hash.DIGITS.tobytes().decode()
    parts = ["".join(digits[mix((polynomial(c) + len(c)) & full) >> 58] for c in chunks_at(b)) for b in (size, 2 * size)]
    return f"{size}:{parts[0]}:{parts[1]}"


def test_fingerprints_byte_by_byte():
    r = random.Random(31)
    texts = [b"", b"a", b"ab" * 40, bytes(range(256)), "é" * 100 + "x"] + [some_words(r, n) for n in (3, 20, 80, 200)]
    for t in texts:
        t = t.encode() if isinstance(t, str) else t
        assert fuzzy_hash.fingerprint(np.frombuffer(t, np.uint8)) == slow_fingerprint(t)


@needs_data
def test_edited_texts_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    order = sorted(texts, reverse=True)
    prints = {i: fuzzy_hash.printed(t) for i, t in texts.items()}
    rows = fuzzy_hash.compare_edited(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t, after = texts[r.doc_id], order[(order.index(r.doc_id) + 1) % len(order)]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + texts[after][:cut]
        assert (r.n_chars, r.edited_sha256, r.fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), prints[r.doc_id])
        assert r.edited_fingerprint == fuzzy_hash.printed(edited)
        near = fuzzy_hash.likenesses([(r.fingerprint, r.edited_fingerprint), (r.fingerprint, prints[after])])
        assert (r.near_edited, r.near_next) == tuple(near)


@needs_data
def test_near_duplicates_lose_no_link(spark):
    df = spark.read.parquet(f"{LARGER}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()} == brute_components(texts)


@needs_data
def test_encoding_of_documents(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    df = spark.read.parquet(f"{LARGER}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    for r in bpe.encode_table(df, outputs=("n_tokens", "ids_sha256", "decoded_sha256")).collect():
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_members_are_inflated_piece_by_piece():
    """A record that would inflate to far more than its content length is refused before it has."""
    import tracemalloc

    lie = warc.record_bytes("response", 1, "http://x", b"", warc.digest_of(b""), None)
    head = zlib.decompress(lie, 31)
    pack = zlib.compressobj(9, zlib.DEFLATED, 31)
    bomb = pack.compress(head) + b"".join(pack.compress(b"0" * (1 << 20)) for _ in range(200)) + pack.flush()
    tracemalloc.start()
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(bomb)))
    assert tracemalloc.get_traced_memory()[1] < 8 << 20
    tracemalloc.stop()
    big = os.urandom(3 << 20)
    whole = warc.record_bytes("response", 1, "http://x", big, warc.digest_of(big), None)
    assert [r.block for r in warc.read_records(io.BytesIO(whole * 2))] == [big, big]
    assert [r.block for r in warc.read_records(io.BytesIO(whole), blocks=False)] == [b""]


@pytest.mark.parametrize("places", [1, 3])
def test_near_copies_in_dealt_buckets(spark, monkeypatch, places):
    monkeypatch.setattr(minhash, "BLOCK", 20)
    monkeypatch.setattr(minhash, "MOST_PLACES", places)
    monkeypatch.setattr("keyloom.llm.common.HOT_ROWS", 4)
    monkeypatch.setattr("keyloom.llm.common.HOT_BYTES", 64)
    texts = near_group(90, 6)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()} == brute_components(texts)


@pytest.mark.parametrize("hot_bytes", [0, 4096])
def test_lookups_of_hot_keys(spark, monkeypatch, hot_bytes):
    monkeypatch.setattr("keyloom.llm.common.HOT_ROWS", 10)
    monkeypatch.setattr("keyloom.llm.common.HOT_BYTES", hot_bytes)
    rows = spark.range(400).selectExpr("if(id % 2 = 0, 'hot', if(id % 7 = 0, null, concat('k', id % 40))) as k", "id as _v", "id as _place", "id")
    table = rows.where("k is not null and k != 'k3'").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    want = {r.k: (r.n, r.top) for r in table.collect()}
    for size in (None, F.lit(100)):
        got = lookup(rows, table, ["k"], "n", 400, F.col("id"), "found", size=size).collect()
        assert len(got) == 400 and all(r._v == r._place == r.id for r in got)
        assert all((tuple(r.found) if r.found else None) == want.get(r.k) for r in got)
