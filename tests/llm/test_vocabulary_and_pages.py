"""Spelling variants, source divergence and page templates against plain versions, and on odd rows."""

import html
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from wardline.llm import page_templates, queries, source_audit, spelling
from wardline.llm.common import table

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n long, word string, ord long, key string"


def frame(spark, rows, schema, path):
    """As a table in files, with its columns of clashing names filled."""
    spark.createDataFrame(rows, schema).write.parquet(str(path))
    return spark.read.parquet(str(path))


def odd_documents(spark, path):
    rows = [
        (1, None, "en", "a"), (2, "", "en", None), (3, " \n\t ... 123", None, "a"), (None, "walking walkings walking", "en", "a"), (None, None, None, None),
        *[(10 + k, "Walking walking talking " * 30, "en", ["a", "b"][k % 2]) for k in range(12)], (10, "Walking walking talking " * 30, "en", "a"),
        (40, "x" * 3000 + " " + "x" * 3000 + " " + "x" * 2999 + " " + "x" * 2999, "de", "b"), (41, "żółć walkinġ 漢字漢字漢字漢字 ünïçödës ünïçödës ünïçödë ünïçödë", "de", "c"),
    ]
    return frame(spark, [(*r, 7, "clash", 7, "clash") for r in rows], DOCS, path)


# --- spelling variants -----------------------------------------------------------------------------


def plain_words(docs, least=7, slip=31):
    n = Counter()
    for d in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", d.text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d.doc_id is None else d.doc_id}:{run}".encode())
            if h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= least
    return {w: k for w, k in n.items() if k >= 2}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(n):
    by_size = {}
    for w in n:
        by_size.setdefault(len(w), []).append(w)
    out, form = {}, {}
    for w in n:
        near = [v for k in (-1, 0, 1) for v in by_size.get(len(w) + k, ()) if one_apart(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
        out[w] = len(near)
    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {w: (form[w], root(w), n[w], out[w], n[form[w]] if form[w] else None) for w in n}


def rows_of(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_variants_of_documents(spark):
    want = plain_variants(plain_words(table(spark, SMALL, "documents").collect()))
    assert rows_of(queries.op11_spelling_variants(spark, SMALL)) == want


def crowd(rng):
    """Dense words of few letters with runs, long shared halves, and chains of rising frequency."""
    few = {"".join(rng.choice("ab") for _ in range(rng.randint(7, 10))) for _ in range(250)}
    long_ = {"commonbeginning" + "".join(rng.choice("abcé") for _ in range(3)) for _ in range(60)} | {"".join(rng.choice("xyz") for _ in range(3)) + "commonending" for _ in range(27)}
    counts = {w: rng.randint(2, 40) for w in few | long_}
    return counts | {"chainword": 2, "chainwords": 30, "chainwordss": 400, "chainwordsss": 5000}


@pytest.mark.parametrize("bucket,crowded", [(spelling.BUCKET, spelling.CROWDED), (300, 120)])
def test_variants_of_crowded_words(spark, tmp_path, bucket, crowded):
    counts = crowd(random.Random(3))
    rows = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(counts.items())]
    docs = frame(spark, rows, "doc_id long, text string", tmp_path / "d")
    got = rows_of(spelling.variants(docs, slip=1 << 40, bucket=bucket, crowded=crowded))
    assert got == plain_variants(counts)
    assert got["chainword"][:2] == ("chainwords", "chainwordsss")


@pytest.mark.parametrize("leftward", [False, True])
def test_index_search_finds_every_neighbour_once(leftward):
    rng = random.Random(8)
    every = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(4, 7))) for _ in range(400)})
    index = spelling.Index(every)
    n = np.arange(len(every))
    got = []
    for longer in (False, True):
        which, found, _ = index.search(n, np.zeros(len(n), np.int64), np.full(len(n), longer), leftward)
        got += list(zip(which.tolist(), found.tolist()))
    want = {(a, b) for a in n.tolist() for b in n.tolist() if a != b and one_apart(every[a], every[b])}
    assert len(got) == len(set(got)) and set(got) == want


def test_suffixes_in_order():
    text = np.frombuffer(b"\0abab\0ababab\0b\0", np.uint8)
    assert spelling.suffix_order(text).tolist() == sorted(range(len(text)), key=lambda k: text[k:].tobytes())


def test_variants_on_odd_rows(spark, tmp_path):
    docs = odd_documents(spark, tmp_path / "d")
    got = rows_of(spelling.variants(docs))
    assert got == plain_variants(plain_words(docs.collect()))
    assert got["x" * 3000][3] == 1 and got["walking"][0] is None
    assert spelling.variants(docs.where("false")).count() == 0 and spelling.variants(docs.where("doc_id = 1")).count() == 0


# --- source divergence -------------------------------------------------------------------------------


def plain_audit(docs, min_docs=10, top=10):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    seen, found = {}, []
    for d in docs:
        t = term.findall((d.text or "").translate(lower))
        found.append((d.lang or "", d.source or "", t))
        seen.setdefault(d.lang or "", Counter()).update(set(t))
    kept = {lang: sorted((t for t, n in c.items() if n >= min_docs), key=str.encode) for lang, c in seen.items()}
    count, whole = {}, {lang: Counter() for lang in kept}
    for lang, source, t in found:
        known = [x for x in t if x in set(kept[lang])] if len(t) < 50 else [x for x in t if seen[lang][x] >= min_docs]
        count.setdefault((lang, source), Counter()).update(known)
        whole[lang].update(known)
    share = lambda c, t, v: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * v)
    apart = lambda p, q: (p - q) ** 2 // (p + q)
    p = {g: {t: share(c, t, len(kept[g[0]])) for t in kept[g[0]]} for g, c in count.items()}
    q = {lang: {t: share(c, t, len(kept[lang])) for t in kept[lang]} for lang, c in whole.items()}
    out = set()
    for g in count:
        pairs = [(s, sum(apart(p[g][t], p[lang, s][t]) for t in kept[lang])) for lang, s in count if lang == g[0] and s != g[1]]
        terms = [(t, apart(p[g][t], q[g[0]][t])) for t in kept[g[0]] if count[g][t] and p[g][t] > q[g[0]][t]]
        for part, items in (("pair", pairs), ("term", terms)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
            out |= {(*g, part, item, value, k) for k, (item, value) in enumerate(ranked, 1) if part == "pair" or k <= top}
    return out


def test_audit_of_documents(spark):
    docs = table(spark, SMALL, "documents")
    want = plain_audit(docs.collect())
    got = [tuple(r) for r in queries.op12_source_divergence(spark, SMALL).collect()]
    assert len(got) == len(want) and set(got) == want


def test_audit_in_shards_passes_blocks_and_tiles(spark, monkeypatch, tmp_path):
    docs = table(spark, SMALL, "documents")
    want = plain_audit(docs.collect(), min_docs=4)
    for name, value in (("SHARD", 37), ("HELD", 500), ("TERMS", 64), ("TILE", 3)):
        monkeypatch.setattr(source_audit, name, value)
    passes = []
    monkeypatch.setattr(source_audit, "streamed", lambda *a, f=source_audit.streamed: passes.append(1) or f(*a))
    got = [tuple(r) for r in source_audit.audit(docs, min_docs=4, pass_bytes=20_000).collect()]
    assert len(got) == len(want) and set(got) == want and len(passes) > 2


def test_transducer_is_minimal_and_numbers_words_in_order():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abcé漢") for _ in range(rng.randint(1, 6))) for _ in range(700)} | {"", "a" * 300}, key=str.encode)
    coded = [w.encode() for w in words]
    machine = source_audit.Transducer.load(**source_audit.Transducer.of(coded).dump())
    assert machine.ordinals(coded).tolist() == list(range(len(words)))
    others = [b"zz", b"a" * 299, b"a" * 301, "漢".encode()[:2], b"abcabcabc"]
    assert machine.ordinals(others).tolist() == [-1] * 5
    tails = {}  # states of the smallest automaton: the different sets of endings
    for w in coded:
        for k in range(len(w) + 1):
            tails.setdefault(w[:k], set()).add(w[k:])
    assert len(machine.final) == len({frozenset(t) for t in tails.values()})
    assert source_audit.Transducer.of([]).ordinals([b"a", b""]).tolist() == [-1, -1]


def test_audit_on_odd_rows(spark, tmp_path):
    docs = odd_documents(spark, tmp_path / "d")
    got = [tuple(r) for r in source_audit.audit(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit(docs.collect())
    assert ("de", "b", "pair", "c", 0, 1) in got and ("en", "", "pair", "a", ) == next(r[:4] for r in got if r[:2] == ("en", ""))
    assert source_audit.audit(docs.where("false")).count() == 0


def test_shares_are_exact_for_large_counts(spark):
    n = 9_000_000_000_000
    r = spark.range(1).selectExpr(f"{n} AS n", f"{3 * n} AS total", "1000 AS kept").select(source_audit.share("n", "total", "kept").alias("p")).first()
    assert r.p == 1 + 10**9 * (n + 2) // (3 * n + 2000)


# --- main text -----------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, text string, tokens string, main string, own string"


def plain_articles(pages):
    """The articles of the given pages, whose paragraphs and headings are never nested."""
    for p in pages:
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", p.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        yield p.page_id, "\n".join(b for b in blocks if b)


def test_articles_of_the_pages(spark):
    got = {r.page_id: r for r in queries.op13_html_main_text(spark, MEDIUM).collect()}
    want = dict(plain_articles(table(spark, MEDIUM, "pages").collect()))
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.n_chars == len(r.text) and r.n_slots > 0 for r in got.values() if r.text)


def said(rng, n=12):
    return " ".join("".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(n))


def plain_site(rng, k):
    """No telling names: a menu of links, paragraphs with one line that all pages share, a list of other pages."""
    text = [said(rng, 30) for _ in range(rng.randint(1, 5))]
    links = "".join(f"<li><a href=/{rng.random()}>{said(rng, 3)}</a></li>" for _ in range(5))
    page = f"<html><body><div class=c1><ul>{links}</ul><p>Some Site</p></div><div class=c2><h2>{text[0]}</h2>{''.join(f'<p>{t}</p>' for t in text[1:])}<p>Tell your friends</p></div><div class=c3><ul>{links}</ul></div><p>All rights are ours.</p>"
    return page, "\n".join(text)


def named_site(rng, k):
    text = [said(rng, 20) for _ in range(3)]
    page = f"""<!doctype html><html><head><title>{text[0]}</title><script>if (a < b) document.write("<p>no</p>")</script></head><body class="no-sidebar"><header class=top><h1>Site</h1></header>
    <div class="cookie-notice">We use cookies {k}</div><nav><a href="?a=1&b=2">menu {k}</a></nav><div id="main-content"><h1>{text[0]}</h1><p title="a > b">{text[1]} <b>x &lt; y</b>&nbsp;&amp; z<br>on
       <div class=ad-box><p>Buy {said(rng)}</p></div><ul><li>{text[2]}<li>two</ul><form><p>search</p><input name=q></form><div class="post-comments"><p>{said(rng)}</p></div></div><aside>{said(rng)}</aside><footer>&copy; {k}</footer></body></html>"""
    return page, "\n".join([text[0], f"{text[1]} x < y & z on", text[2], "two"])


@pytest.mark.parametrize("site", [plain_site, named_site])
def test_templates_of_other_sites(spark, tmp_path, site):
    rng = random.Random(4)
    pages = [site(rng, k) for k in range(30)]
    df = frame(spark, [(k, f"https://www.site.org/{k}", p, "c", "c", "c", "c") for k, (p, _) in enumerate(pages)], PAGES, tmp_path / "p")
    got = {r.page_id: r.text for r in page_templates.main_text(df).collect()}
    assert got == {k: t for k, (_, t) in enumerate(pages)}


def test_classes_share_occurrence_vectors(spark, tmp_path):
    rng = random.Random(4)
    df = frame(spark, [(k, "https://s.org/", plain_site(rng, k)[0]) for k in range(9)], "page_id long, url string, html string", tmp_path / "p")
    rows = df.selectExpr("page_id", "'s.org' AS host", "cast(page_id as string) AS who", "html")
    got = page_templates.candidates(rows, 5, 0.5).collect()[0]
    number = page_templates.numbered(got.classes)
    taker, vectors = page_templates.Pages(), {}
    for r in df.collect():
        for token, n in Counter(t[0] for t in taker.tokens(r.html)).items():
            vectors.setdefault(page_templates.signed(token), {})[r.page_id] = n
    kept = {t: frozenset(v.items()) for t, v in vectors.items() if len(v) >= 5}
    assert set(number) == set(kept)
    for a in kept:
        for b in kept:
            assert (number[a] == number[b]) == (kept[a] == kept[b])


def test_nesting():
    order, failed = page_templates.nested([(1, 0), (5, 2), (6, 2), (5, 2), (6, 2), (2, 0)])
    assert not failed and set(order) == {0, 2}
    assert page_templates.nested([(1, 0), (5, 2), (2, 0), (6, 2)])[1] == {2}
    assert page_templates.nested([(5, 2), (6, 2), (6, 2), (5, 2)])[1] == {2}


def test_copies_keep_their_text(spark, tmp_path):
    page = "<body><nav>x</nav><article><h1>Same title</h1><p>The same text on every page of this host.</p></article>"
    df = frame(spark, [(k % 7, "http://h.com/a", page, "c", "c", "c", "c") for k in range(14)], PAGES, tmp_path / "p")
    got = page_templates.main_text(df).collect()
    assert len(got) == 14 and {r.text for r in got} == {"Same title\nThe same text on every page of this host."}


def test_odd_pages(spark, tmp_path):
    deep = "<div>" * 3000 + "deep text" + "</div>" * 2999
    odd = [None, "", " ", "just text", "<", "a < b and <b>c", "<p>one<p>two", "<!-- never ends <p>x", "<script>never ends", "<p title=\"open>x", "<article>" + "long text " * 50_000, deep, "</p></div>text", "<td>a<td>b"]
    rows = [(k, ["http://a.com/x", None, "odd"][k % 3], t, "c", "c", "c", "c") for k, t in enumerate(odd)]
    df = frame(spark, [*rows, rows[3], rows[3], (None, None, None, None, None, None, None)], PAGES, tmp_path / "p")
    found = page_templates.main_text(df).collect()
    assert len(found) == len(odd) + 3 and all(r.n_chars == len(r.text) for r in found)
    got = {r.page_id: r.text for r in found}
    assert [got[k] for k in range(9)] == ["", "", "", "just text", "<", "a < b and c", "one\ntwo", "", ""]
    assert got[10] == ("long text " * 50_000).strip() and got[11] == "deep text" and got[12] == "text" and got[13] == "a\nb" and got[None] == ""
    assert page_templates.main_text(df.where("false")).count() == 0
