"""Decontamination, SimHash, substrings, language, quality, HTML against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from culprit.llm import html as H, langid as L
from culprit.llm.components import connected_components
from culprit.llm.decontam import decontaminate
from culprit.llm.langid import identify, train as train_langid
from culprit.llm.quality import classify, isotonic, train as train_quality
from culprit.llm.simhash import fingerprint, near_duplicates, plan
from culprit.llm.suffix import deduplicate

RNG = random.Random(5)
VOCAB = ["".join(RNG.choices("abcdefghij", k=RNG.randint(1, 7))) for _ in range(300)]


def prose(n: int) -> str:
    return " ".join(RNG.choices(VOCAB, k=n))


PASSAGE, LINE = prose(60), "one line that is known everywhere"
BASE = prose(200)


def make_texts() -> list:
    out = [None, "", " ", "x", "éè" * 80, "ab" * 300, BASE, BASE, BASE.replace("a", "b", 1), BASE + " tail", "12 !! --", "A" * 99, "A" * 100, "A" * 101]
    for k in range(30):
        out.append(prose(40) + (f"\n{LINE}\n" if k % 2 else " ") + (PASSAGE if k % 3 == 0 else "") + " " + prose(30))
    words = BASE.split()
    for k in range(12):  # near copies
        w = list(words)
        w[RNG.randrange(len(w))] = "changed%d" % k
        out.append(" ".join(w))
    out.append(prose(9000))
    return out


TEXTS = make_texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(3 * i - 50, t, "en", "s", 1, "clash", 7) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, key int").repartition(5)


def roots(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def test_components(spark):
    path = spark.range(3000).selectExpr("id as a", "id + 1 as b")  # as many rounds as it takes
    assert connected_components(path).where("component <> 0").count() == 0
    links = [(i, i + 1) for i in range(20)] + [(40, 30), (30, 35), (50, 50), (61, 60), (60, 61)]
    got = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(21), 0), 40: 30, 30: 30, 35: 30, 61: 60, 60: 60}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontamination(spark, docs):
    items = [(1, PASSAGE), (10, PASSAGE[:200]), (2, LINE), (3, ""), (4, None), (5, "a"), (6, "never seen words here"), (2, LINE)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    windows = {}
    for i, t in items:
        w = word.findall(low(t))
        for k in range(max(1, len(w) - 12)) if w else ():
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    want = {}
    for i, t in enumerate(TEXTS):
        w, hit, found = word.findall(low(t)), set(), set()
        for p, ids in windows.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    found |= ids
        want[3 * i - 50] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    for size in (1 << 20, 2000):  # one group of patterns, and several
        got = {r[0]: tuple(r)[1:6] for r in decontaminate(docs, bench, pattern_bytes=size, keep=("fp",)).collect()}
        assert got == want
    assert decontaminate(docs, bench.limit(0)).where("contaminated or n_hit > 0").count() == 0
    assert decontaminate(docs.limit(0), bench).count() == 0


def test_simhash(docs):
    f = [fingerprint(t or "") for t in TEXTS]
    near = [(a, b) for a in range(len(f)) for b in range(a) if (f[a] ^ f[b]).bit_count() <= 3]
    r = roots(len(f), near)
    want = {3 * i - 50: (f"{x:016x}", 3 * r[i] - 50) for i, x in enumerate(f)}
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in near_duplicates(docs).collect()}
    assert got == want and len(near) > 3
    assert near_duplicates(docs.limit(0)).count() == 0
    assert near_duplicates(docs.where("doc_id = -50")).count() == 1


def test_pigeonhole_plan_covers_tau():
    for n in (100, 10**5, 10**8):
        p = np.linspace(0.3, 0.7, 64)
        parts = plan(n, p, np.eye(64), 3)
        assert sum(x.radius + 1 for x in parts) > 3
        assert len({b for x in parts for b in x.bits}) == sum(len(x.bits) for x in parts)


def test_substrings(docs):
    seen, want = set(), {}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        mask = np.zeros(len(raw), bool)
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                mask[k : k + 100] = True
            seen.add(raw[k : k + 100])
        kept = np.frombuffer(raw, np.uint8)[~mask].tobytes()
        spans = int(mask[:1].sum()) + int((mask[1:] & ~mask[:-1]).sum())
        want[3 * i - 50] = (len(raw), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest())
    got = {r[0]: tuple(r)[1:5] for r in deduplicate(docs).collect()}
    assert got == want
    rows = deduplicate(docs, keep=("fp",), with_text=True).where("doc_id = 100").collect()
    assert rows[0].fp == "clash" and len(rows[0].kept_text.encode()) == rows[0].n_bytes - rows[0].n_removed
    assert deduplicate(docs.limit(0)).count() == 0


def test_substrings_with_repeated_and_null_ids(spark):
    rows = [(None, BASE), (1, BASE), (1, BASE), (2, prose(100)), (2, "other " + PASSAGE), (None, PASSAGE)]
    got = sorted(((r.doc_id or 0), r.n_removed, r.n_bytes) for r in deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert len(got) == 6 and [g for g in got if g[0] == 1] == [(1, len(BASE), len(BASE))] * 2


def test_language(spark):
    sets = {"aa": "abcde", "bb": "vwxyz", "gr": "αβγδε"}
    word = lambda s: "".join(RNG.choices(s, k=5))
    rows = [(i, " ".join(word(sets[x]) for _ in range(30)), x) for i, x in enumerate(list(sets) * 20)]
    rows += [(900, None, "aa"), (901, "123 !!", None), (902, "", None), (903, "vwxyz " * 40 + "abcde " * 10, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train_langid(docs)
    got = {r.doc_id: r for r in identify(docs, model, spans=True).collect()}
    assert all(got[i].lang_pred == x for i, t, x in rows if i < 900)
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert got[903].lang_pred == "bb" and [s.lang for s in got[903].spans] == ["bb", "aa"] and got[903].spans[1].first == 40
    assert identify(docs, train_langid(docs.limit(0))).where("lang_pred <> 'und'").count() == 0
    assert identify(docs.limit(0), model).count() == 0


def test_quality(spark):
    good = [(i, prose(80) + ".", 1) for i in range(200)]
    bad = [(1000 + i, " | ".join(RNG.choices(VOCAB, k=60)).upper() + "!!", 0) for i in range(100)]
    rows = good + bad + [(5000, None, None), (5001, "", None), (5001, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x int")
    labels = docs.select("doc_id", F.col("x").alias("quality"))
    model = train_quality(docs, labels.where("doc_id % 3 <> 1"))
    got = classify(docs, model, keep=("x",)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id % 3 == 1 and r.x is not None]
    assert sum(r.predicted == r.x for r in held) >= 0.98 * len(held)
    assert train_quality(docs, labels.limit(0)) is None
    assert classify(docs, None).where("predicted = 0").count() == 0
    assert isotonic(np.array([0.1, 0.5, 0.3, 0.9]), np.ones(4)).tolist() == [0.1, 0.4, 0.4, 0.9]


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><p>Site name</p></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="ad">Buy this now</div>
<article><h1>Title  of
 it &amp; more</h1><p><b>First para&shy;graph.<br><p>Second &lt;one&gt;</p><div class="share-buttons">share</div><p>To.</p>
<aside>aside</aside><form><p>form text</p></form><section id="comments"><p>nice post</p></section><p>Last</p></article>
<div class="sidebar"><p>side</p></div><footer>&copy; foot</footer></body></html>"""


def test_html_article():
    assert H.main_text(PAGE) == "Title of it & more\nFirst para­graph.\nSecond <one>\nTo.\nLast"
    assert H.main_text("") == "" and H.main_text("<p") == "<p" and H.main_text("plain text") == "plain text"
    assert H.main_text("<nav><a>x</a></nav>") == ""


def test_html_without_article():
    body = "".join(f"<p>{prose(30)}</p>" for _ in range(6))
    page = f"<body><div id='menu'><a href=x>one</a></div><ul><li><a href=1>link one</a><li><a href=2>link two</a></ul><h2>Head</h2>{body}<p>end</p><div class=footer>f</div></body>"
    lines = H.main_text(page).split("\n")
    assert lines[0] == "Head" and lines[-1] == "end" and len(lines) == 8


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (1, "u", PAGE), (4, "u", "<p>x" * 20_000)], "page_id long, url string, html string")
    got = H.extract(pages).collect()
    assert len(got) == 5 and {r.n_chars for r in got if r.page_id in (2, 3)} == {0}
    assert all(r.n_chars == len(r.text) for r in got)


def test_html_long_attribute_values():
    for q in "\"'":
        value = "<p>not text</p> > " * 500 + ("'" if q == '"' else '"')
        assert H.main_text(f"<div data-x={q}{value}{q} title=a>{'word ' * 30}</div><p>next</p>") == "word " * 29 + "word\nnext"
    assert H.main_text("<p title=\"open>one</p><p>two</p>") == "one\ntwo"
    assert H.main_text("<p>it</p><p don't>two</p><p>isn't</p>") == "it\ntwo\nisn't"
    assert H.main_text("<article><p>one</p><b class=\"x\">two</b><p title=\"a>three</p><p class=\"").startswith("one\ntwo\nthree")
    assert H.main_text("<div data-html='<i class=\"ad\">'>kept</div>") == "kept"


def test_html_broken_quotes_take_linear_time():
    import time

    for piece in ("<p a=\"", "<p a='1>1' ", "<p", "<p a=\"b>", "</"):
        start = time.perf_counter()
        H.main_text(piece * 40_000)
        assert time.perf_counter() - start < 5, piece


def test_html_hints_are_whole_tokens_and_keep_most_text():
    body = "".join(f"<p>{prose(30)}</p>" for _ in range(4))
    plain = H.main_text(f"<div>{body}</div>")
    assert len(plain.split("\n")) == 4
    for name in ("page no-sidebar", "layout sidebar-right", "has-header", "content search-results"):
        assert H.main_text(f'<div class="{name}">{body}<div class="sidebar"><div>{prose(9)}</div></div></div>') == plain, name
    assert H.main_text(f'<div class="ad"><p>{prose(20)}</p></div><div>{body}</div><div id="page-footer"><p>{prose(20)}</p></div>') == plain
    assert H.main_text(f'<div class="comments">{body}{body}</div><div>{body}</div>') == plain
    inner = '<div class="article-header"><h1>Head</h1></div><p>a <b class="alert">bold</b> word</p><div class="cookie-notice"><div>no</div> no</div><p>end</p>'
    assert H.main_text(f"<article>{inner}</article>") == "Head\na bold word\nend"


def test_html_dive_ends_unmarked_text():
    body = "".join(f"<p>{prose(40)}</p>" for _ in range(5))
    want = H.main_text(f"<div>{body}</div>").split("\n")
    assert len(want) == 5
    tail = "<div>Copyright 2024 Some Site</div><div>All rights reserved</div>" + "".join(f"<div class=x>Item {k}</div>" for k in range(8))
    assert H.main_text(f"<div>{body}</div>{tail}").split("\n") == want
    assert H.main_text(f"<div>{body}<p>end</p></div>{tail}").split("\n") == [*want, "end"]
    gap = "".join(f"<p>Short {k}</p>" for k in range(8))  # the text goes on after short lines
    again = H.main_text(f"<div>{body}{gap}{body}</div>{tail}").split("\n")
    assert again == [*want, *(f"Short {k}" for k in range(8)), *want]


def test_decontamination_of_items_without_id(spark, docs):
    bench = spark.createDataFrame([(None, PASSAGE), (7, LINE)], "item_id long, text string")
    named = spark.createDataFrame([(1, PASSAGE), (7, LINE)], "item_id long, text string")
    for size in (1 << 20, 2000):
        got, want = ({r.doc_id: r for r in decontaminate(docs, b, pattern_bytes=size).collect()} for b in (bench, named))
        assert all((got[k].n_hit, got[k].contaminated) == (w.n_hit, w.contaminated) for k, w in want.items())
        assert sum(r.contaminated and not r.n_items for r in got.values()) > 2 and max(r.n_items for r in got.values()) == 1


def test_html_keeps_text_that_odd_markup_surrounds():
    body = "".join(f"<p>{prose(30)}</p>" for _ in range(4))
    plain = H.main_text(f"<div>{body}</div>")
    assert H.main_text(f"<div><a name=x>{body}</div>") == plain  # nothing closes the anchor
    assert H.main_text(f"<form action=x>{body}</form>") == plain  # a form around the whole page
    assert H.main_text(f"<div class=ad>{body}") == plain  # nothing closes the advert
    assert H.main_text(f"<form><p>Search the site</p></form><div>{body}</div><form><p>Subscribe now</p></form>") == plain
    assert H.main_text(f"<div>{body}<p><a href=x>one linked paragraph</a></p>{body}</div>") == f"{plain}\none linked paragraph\n{plain}"
    assert H.main_text(f"<article><section class='related-work'>{body}</section></article>") == plain
    assert H.main_text("<article><p>a</p><form><p>form text</p></form><p>b</p></article>") == "a\nb"
    assert H.main_text(f"<div>{body}</div><div>Copyright</div><div>Terms of use</div><div>Contact us</div>") == plain


def line_blocks(size: list[int], width: int, surge: int) -> tuple[int, int]:
    """First and last line by the definition: windows from the first surge to the last one before all sums stay low."""
    sums = [sum(size[k : k + width]) for k in range(len(size))]
    need = min(surge, max(sums))
    first = next(k for k in range(len(sums)) if sums[k] >= need)
    later = sorted(s for s in sums[first:] if s >= need)
    usual = later[len(later) // 2]
    low, again = max(usual // 4, min(need, usual)), max(usual // 2, min(need, usual))
    open_at, up = [], True
    for k in range(first, len(sums)):
        up = sums[k] >= low if up else sums[k] >= again
        if up:
            open_at.append(k)
    covered = [j for k in open_at for j in range(k, min(k + width, len(size))) if size[j] * width >= low or j == k]
    return next(k for k in range(first, len(size)) if size[k]), max([*covered, first])


def test_html_surge_and_dive_against_the_definition():
    for _ in range(200):
        size = [RNG.choice([0, 0, 5, 12, 150, 300]) for _ in range(RNG.randint(1, 25))]
        if not any(size):
            continue
        page = "".join(f"<div>{chr(97 + k % 26) * n}</div>" for k, n in enumerate(size) if n)
        size = [n for n in size if n]
        first, last = line_blocks(size, 3, 80)
        got = H.main_text(page).split("\n")
        lengths = [len(x) for x in got]
        assert lengths[: last - first + 1] == size[first : last + 1], (size, lengths)


def test_language_needs_letters_and_knows_scripts(spark):
    rows = [(0, "½ ²"), (1, "Ⅳ 12"), (2, "..."), (3, "ab\u0301c"), (4, "नमस्ते दुनिया")]
    assert L.words_of(pa.array([t for _, t in rows])).to_pylist()[:3] == [[], [], []]
    assert L.words_of(pa.array(["it's 2x नमस्ते—ok"])).to_pylist() == [["its", "x", "नमस्तेok"]]
    for word, script in (("нет", "cyrillic"), ("aнет", "cyrillic"), ("नमस्ते", "devanagari"), ("naïve", "latin")):
        assert L.SCRIPTS[L.scripts_of(L.code_points(word), np.zeros(1, np.int64))[0]] == script


def test_viterbi_against_brute_force():
    counts = [(lang, g, RNG.randint(1, 30)) for lang in ("aa", "bb", "cc") for g in {x for w in RNG.sample(VOCAB, 80) for x in L.grams_of(w)}]
    counts += [(lang, "script:latin", 1000) for lang in ("aa", "bb", "cc")]
    model = L.Model(counts, switch=2.0)
    table = {(lang, g): n for lang, g, n in counts}
    every = {g for _, g, _ in counts if not g.startswith("script:")}
    total = {x: sum(n for (lang, g), n in table.items() if lang == x and g in every) for x in model.langs}
    words = RNG.sample(VOCAB, 60) + ["zzz", "a" * 50]
    for w, got in zip(words, model.score(words), strict=True):
        s = np.array([sum(np.log((table.get((x, g), 0) + 0.5) / (total[x] + 0.5 * (len(every) + 1))) for g in L.grams_of(w)) for x in model.langs])
        assert np.allclose(got, np.maximum(s - s.max(), -8), atol=2e-3)
    for _ in range(40):
        text = RNG.choices(VOCAB, k=RNG.randint(1, 7))
        s = model.score(text)
        best = max(itertools.product(range(3), repeat=len(text)), key=lambda p: (sum(float(s[k, x]) for k, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))))
        value = lambda p: sum(float(s[k, x]) for k, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))
        (_, _, spans), = L.Labeller(model).label(pa.array([" ".join(text)]), spans=True)
        path = [model.langs.index(x["lang"]) for x in spans for _ in range(x["first"], x["last"] + 1)]
        assert abs(value(path) - value(best)) < 1e-3


def test_large_buckets_equal_small_ones(spark, monkeypatch):
    from culprit.llm import suffix as S

    passage = prose(40)
    rows = [(k, prose(8) + " " + passage + " " + prose(8)) for k in range(260)]  # more contents of one key than one task compares
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: tuple(r) for r in deduplicate(docs).collect()}
    monkeypatch.setattr(S, "GROUP", 1000)
    assert {r.doc_id: tuple(r) for r in deduplicate(docs).collect()} == got
    assert sum(r[2] > 0 for r in got.values()) == 259


def test_bucket_pointers_compare_bytes():
    from culprit.llm.suffix import bucket_pointers

    raw = bytes(RNG.choices(b"ab", k=900)) + b"x" * 300 + bytes(RNG.choices(b"abc", k=700))
    raw += raw[200:800] + raw[:300]
    for depth in (8, 20, 100):
        for some in (np.arange(len(raw) - depth + 1), np.array(sorted(RNG.sample(range(len(raw) - depth), 400)))):
            pointer, by = bucket_pointers(raw, depth, some), {}
            for k in some.tolist():
                by.setdefault(raw[k : k + depth], set()).add(int(pointer[k]))
            assert all(len(v) == 1 for v in by.values()) and len({min(v) for v in by.values()}) == len(by)


def test_extra_columns_with_clashing_names(spark):
    names = "code fp key node text1 score predicted spans n_tokens shard kind __text doc row k0 t1 component".split()
    docs = spark.createDataFrame([(1, prose(30), "en", *range(len(names))), (2, None, "en", *range(len(names)))], "doc_id long, text string, lang string, " + ", ".join(f"{n} int" for n in names))
    assert classify(docs, None).count() == identify(docs, train_langid(docs)).count() == near_duplicates(docs).count() == deduplicate(docs).count() == 2
    pages = docs.selectExpr("doc_id as page_id", "text as html", "lang as url", "code as text", "fp as n_chars")
    assert H.extract(pages).count() == 2 and H.extract(pages.limit(0)).count() == 0
    assert train_quality(docs.limit(0), docs.selectExpr("doc_id", "1 as quality")) is None


def test_very_long_texts(spark):
    long = prose(200_000)
    docs = spark.createDataFrame([(1, long, "en"), (2, "w" * 3_000_000, "en"), (3, prose(20), "en")], "doc_id long, text string, lang string")
    assert near_duplicates(docs).count() == deduplicate(docs).count() == classify(docs, None).count() == 3
    found = identify(docs, train_langid(docs.where("doc_id = 3"))).collect()
    assert len(found) == 3 and all(r.lang_pred == "en" for r in found)
    bench = spark.createDataFrame([(1, " ".join(long.split()[100_000:100_020]))], "item_id long, text string")
    assert decontaminate(docs, bench).where("n_hit > 0").count() == 1
