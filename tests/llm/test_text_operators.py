"""Packing, token counts, decontamination, line dedup, passages and HTML against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import corpus
import numpy as np
import pytest
from spanloom.llm import decontaminate, html_extract, line_dedup, packing, passages, tokencount
from spanloom.llm.queries import COUNTING_VOCABULARY, PACKING_VOCABULARY, vocabulary

TEXTS = ["Hello  world\n\n it's <|endoftext|> ok", "tab\there   x　y ", "naïve café — ünïcode 😀😀", " leading", "trailing  ", "▁odd▁ marks ▁", "a\n\n\nb \n c", "3.14 and 1,000,000", "<s>x</s> <unk>"]


def test_packing_equals_tokenizers(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary(PACKING_VOCABULARY))
    rng = random.Random(2)
    rows = corpus.ODD + [(1000 + k, t) for k, t in enumerate(TEXTS)] + [(2000, corpus.prose(rng, 3000))]
    docs = spark.createDataFrame(corpus.clashing(rows), corpus.CLASHING)
    got = packing.pack(docs, vocabulary(PACKING_VOCABULARY)).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    assert all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 1024 and r.bucket == r.length for r in got)
    for i, t in {i: t for i, t in rows}.items():
        want = library.encode(t or "", add_special_tokens=False).ids + [0]
        pieces = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        copies = sum(j == i for j, _ in rows)
        assert {r.doc_tokens for r in pieces} == {len(want)} and sum(r.length for r in pieces) == copies * len(want)
        for r in pieces:
            own = want[r.start : r.start + r.length]
            assert r.ids == own and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
    assert packing.pack(docs.limit(0), vocabulary(PACKING_VOCABULARY)).collect() == []


def test_packing_ids_of_long_runs_equal_tokenizers():
    from tokenizers import Tokenizer

    path = vocabulary(PACKING_VOCABULARY)
    library = Tokenizer.from_file(path)
    for text in (" " * 3_000_000, "a" + "\n\t " * 1_000_000 + "b", "x" * 2_000_000, "z " * 200_000 + " " * 1_500 + "<|endoftext|>" + " " * 2_000 + "!", "." * 300_000 + " " * 999 + "a"):
        assert np.array_equal(packing.token_ids(path, text), library.encode(text, add_special_tokens=False).ids)


def test_packing_lays_equal_lengths_together(spark):
    rng = random.Random(9)
    docs = spark.createDataFrame([(k, corpus.prose(rng, rng.randint(1, 900))) for k in range(200)], "doc_id long, text string").repartition(3)
    for part in packing.pack(docs, vocabulary(PACKING_VOCABULARY), with_ids=False).rdd.glom().collect():
        assert [r.bucket for r in part] == sorted(r.bucket for r in part)


@pytest.mark.parametrize(("n", "want"), [(1, [1]), (1024, [1024]), (1023, [512, 256, 128, 64, 32, 16, 8, 4, 2, 1]), (2050, [1024, 1024, 2])])
def test_piece_lengths(n, want):
    assert packing.piece_lengths(n, 1024).tolist() == want


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary(COUNTING_VOCABULARY))
    rows = corpus.ODD + [(1000 + k, t) for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(corpus.clashing(rows), corpus.CLASHING)
    got = tokencount.prefix_counts(docs, vocabulary(COUNTING_VOCABULARY), budget=7).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == Counter((i, len((t or "").encode()), len(library.encode(t or ""))) for i, t in rows)
    every = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    counted = tokencount.prefix_counts(every, vocabulary(COUNTING_VOCABULARY), budget=7, store="char")
    for r in counted.collect():
        prefixes = [len(library.encode(TEXTS[r.doc_id][:j])) for j in range(len(TEXTS[r.doc_id]) + 1)]
        assert r.counts == prefixes and r.fit_chars == max(j for j, n in enumerate(prefixes) if n <= 7)
    assert {r.doc_id: r.prefix_tokens for r in tokencount.tokens_in_prefix(counted, 3).collect()} == {k: len(library.encode(t[:3])) for k, t in enumerate(TEXTS)}


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(rows, items, size=13):
    windows = {}
    for name, text in items:
        w = words_of(text) if name is not None else []
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(name))
    out = []
    for i, text in rows:
        w, hit, names = words_of(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                found = windows.get(tuple(w[k : k + n]))
                if found:
                    names |= found
                    hit |= set(range(k, k + n))
        out.append((i, len(w), len(hit), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_decontamination(spark, block):
    rng = random.Random(4)
    items = [(k, corpus.prose(rng, 30, ("a", "b", "é"))) for k in range(12)] + [(12, "Short one"), (13, None), (None, "no id at all"), (14, "..."), (15, "that " * 20)]
    rows = list(corpus.ODD)
    for k in range(60):
        text = corpus.prose(rng, 80, ("a", "b", "c")).split()
        item = items[k % 12][1].split()
        at, n = rng.randrange(60), rng.choice((5, 13, 20, 30))
        rows.append((k, " ".join(text[:at] + item[:n] + text[at:])))
    rows += [(200, "x, that; " * 40), (201, "a SHORT, one!"), (202, items[3][1]), (203, "short oneshort one")]
    docs = spark.createDataFrame(corpus.clashing(rows), corpus.CLASHING)
    benchmark = spark.createDataFrame([(n, t, "z") for n, t in items], "item_id long, text string, id string")
    found = decontaminate.hits(docs, benchmark, block_bytes=block)
    got = found.collect()
    # one read of the documents, however many blocks
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert Counter((r.doc_id, r.n_words, r.n_hit, hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) for r in got) == brute_hits(rows, items)
    text = dict(rows)
    for r in got:
        if r.doc_id is not None and r.spans:
            assert sum(len(words_of(text[r.doc_id].encode()[s.a : s.b].decode())) for s in r.spans) == r.n_hit
    bad = {r.doc_id for r in got if r.n_hit and 20 * r.n_hit >= r.n_words}
    kept = decontaminate.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _ in rows if i not in bad)
    assert {r.n_hit for r in decontaminate.hits(docs, benchmark.limit(0)).collect()} == {0}
    assert decontaminate.hits(docs.limit(0), benchmark).collect() == []


def test_line_dedup(spark):
    rng = random.Random(6)
    rows = [(k, "s1" if k % 2 else "s2", "\n".join([corpus.prose(rng, 5), "Menu | Home" if k % 4 == 1 else "", corpus.prose(rng, 4), "Menu | Home" if k % 8 == 1 else "x"])) for k in range(80)]
    rows += [(100, None, "Menu | Home"), (101, "s1", None), (102, "s1", ""), (103, "s1", "Menu | Home"), (103, "s1", "Menu | Home"), (104, "tiny", "a\nb"), (105, "tiny", "a\nb")]
    rows += [(k, "s1", "\t\n \r\n\x0b\nonly once " + str(k)) for k in range(200, 240)]
    docs = spark.createDataFrame([(*r, "lines", 1, "l", "k") for r in rows], "doc_id long, source string, text string, _host string, n int, _lines string, _kept string")
    pages = Counter(h for _, h, _ in rows if h is not None)
    rows += [(300 + k, "s2", "copied\nfrom page to page" + " and so on" * (k % 2)) for k in range(30)]
    pages = Counter(h for _, h, _ in rows if h is not None)
    docs = spark.createDataFrame([(*r, "lines", 1, "l", "k") for r in rows], docs.schema)
    seen = {}
    for _, h, t in rows:
        filled = {line for line in (t or "").split("\n") if line.strip(" \t\n\x0b\x0c\r")} if h is not None else ()
        for line in filled:
            seen.setdefault((h, line), set()).add(max(filled - {line}, key=lambda x: (len(x), x.encode()), default=None))
    drop = {k for k, besides in seen.items() if len(besides) >= 3 and 100 * len(besides) > 10 * pages[k[0]]}
    assert ("s1", "Menu | Home") in drop and ("s2", "x") in drop and ("s2", "copied") not in drop
    want = Counter((i, h, t if t is None or h is None else "\n".join(x for x in t.split("\n") if (h, x) not in drop)) for i, h, t in rows)
    kept = line_dedup.drop_boilerplate(docs)
    assert kept.columns == docs.columns and Counter((r.doc_id, r.source, r.text) for r in kept.collect()) == want
    assert line_dedup.drop_boilerplate(docs.limit(0)).collect() == []


def test_passages(spark):
    rng = random.Random(8)
    vocabulary_ = [f"w{k}" for k in range(4000)]
    some = lambda n: [rng.choice(vocabulary_) for _ in range(n)]
    passage, rows = some(60), []
    for k in range(40):
        text = some(rng.randint(60, 200))
        if k % 4 == 0:
            at = rng.randrange(len(text))
            text[at:at] = passage
        rows.append((k, " ".join(text).replace(" w1", "\nW1")))
    common = " ".join(some(12))
    rows += [(100 + k, " ".join(some(50)) + "\n" + common) for k in range(5)]
    rows += [(300, rows[1][1]), (301, rows[1][1]), *corpus.ODD, (310, "that " * 3000), (311, "this " * 30 + "that " * 100)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, _id int, _spans string")
    got = passages.repeated(docs).collect()
    assert {r.doc_id for r in got} == {4, 8, 12, 16, 20, 24, 28, 32, 36, 300, 301, 311}
    text = dict(rows)
    for r in got:
        own = text[r.doc_id].lower().split()[r.first_word : r.first_word + r.n_words]
        assert r.kept_id < r.doc_id and " ".join(own) in " ".join(text[r.kept_id].lower().split())
    whole = len(text[1].split())
    assert all(sum(r.n_words for r in got if r.doc_id == i) == whole for i in (300, 301))
    assert all(sum(r.n_words for r in got if r.doc_id == k) >= len(passage) for k in range(4, 40, 4))
    cut = passages.cut_repeated(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    left = {r.doc_id: r.text for r in cut.collect()}
    assert left[1] == text[1] and left[900] is None and left[104] == text[104]
    assert len(left[4].split()) == len(text[4].split()) - sum(r.n_words for r in got if r.doc_id == 4)
    assert passages.repeated(docs.limit(0)).collect() == []
    twice = spark.createDataFrame([(1, text[1]), (2, text[1]), (2, "short"), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in passages.cut_repeated(twice).collect() if r.text is not None) == [(1, text[1]), (2, ""), (2, "")]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var x="</p>";</script></head><body>
<header><a href=/>Site</a></header><nav><ul><li><a>Home<li><a>News</ul></nav><div class="cookie-notice">We use cookies</div>
<div id="wrap"><div class="content">{body}</div><aside>See also</aside><div class="comments"><p>Nice!</p></div></div>
<form><input name=q><button>Go</button></form><footer>&copy; Site</footer></body></html>"""


def test_html_extraction(spark):
    bodies = [f"<h1>Title {k} &amp; more</h1><p>First  <b>part</b>\n {k}<br>x<p>Second {k} &lt;b&gt; &#233;<ul><li>one {k}<li>two {k}</ul><div class=ad>Buy</div>" for k in range(6)]
    pages = [(k, f"https://Host.example/{k}", PAGE.format(body=b)) for k, b in enumerate(bodies)]
    pages += [(10, None, "<p>alone</p>"), (11, "https://host.example/e", None), (12, "https://host.example/f", ""), (13, "no url", "plain text &amp; <i>more</i>"), (None, "https://host.example/g", PAGE.format(body="<p>same</p>")), (14, "https://other.example/", "<article><p>Kept <!-- not --> here<p>and here</article><p>outside"), (15, "https://other.example/x", "<div" * 50 + "<p>x"), (16, None, '<div id="header">Site name</div><div class="text"><h1 class="header">Head</h1><p>body</div>'), (17, None, '<article><div class="header">Own head</div><p>body</article>')]
    df = spark.createDataFrame([(*p, "t", 1) for p in pages], "page_id long, url string, html string, text string, host int")
    got = {r.page_id: r for r in html_extract.main_text(df).collect()}
    for k in range(6):
        assert got[k].text == f"Title {k} & more\nFirst part {k} x\nSecond {k} <b> é\none {k}\ntwo {k}"
    assert [got[k].text for k in (10, 11, 12, 13, 14)] == ["alone", "", "", "plain text & more", "Kept here\nand here"]
    assert got[16].text == "Head\nbody" and got[17].text == "Own head\nbody"
    assert got[None].text == "same" and len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got.values())
    assert html_extract.main_text(df.limit(0)).collect() == []


def largest_matching(w, x):
    """Simple tree matching written as its definition, by trying every ordered matching of children."""
    if w.label != x.label:
        return 0
    left, right = w.children, html_extract.elements(x)

    def rest(i, j, again):
        if i == len(left) or j == len(right):
            return 0
        out = max(rest(i + 1, j, False), rest(i, j + 1, again))
        own = largest_matching(left[i], right[j])
        if own:
            out = max(out, own + rest(i + 1, j + 1, False))
            if left[i].repeats:
                out = max(out, own + rest(i, j + 1, True))
        return out

    return 1 + rest(0, 0, False)


def test_tree_matching_is_the_largest_ordered_one():
    rng = random.Random(12)

    def tree(depth):
        return "".join(f"<{t}>{tree(depth - 1) if depth else ''}</{t}>" for t in rng.choices(("div", "ul", "section"), k=rng.randint(0, 3)))

    for _ in range(300):
        wrapper, page = html_extract.Part("#root"), html_extract.parse(tree(2))
        html_extract._add(wrapper, html_extract.parse(tree(2)))
        score, pairs = html_extract.align(wrapper, page)
        assert score == largest_matching(wrapper, page) == len(pairs)
        below = {id(c): p for _, p in pairs for c in html_extract.elements(p)}
        for w, x in pairs[1:]:
            assert w.label == x.label and any(p is below[id(x)] and w in v.children for v, p in pairs)


SITE = """<body><div class="top">My site</div><div class="c{k}"><ul><li>Home<li>About us</ul></div><div class="wrap"><div class="text"><h1>{title}</h1><p>{one}</p>
<div class="box">Subscribe to our letter and get it every week</div><p>{two}</p><div class="social-history"><p>{three}</p></div><p class="notice-board">{four}</p>
<section class="comments"><p>{five}</p></section></div></div><div class="last">All rights reserved by the site and its people</div></body>"""


def test_constant_texts_of_a_host_are_its_template(spark):
    rng = random.Random(13)
    parts = [{n: corpus.prose(rng, 12) for n in ("title", "one", "two", "three", "four", "five")} for _ in range(20)]
    pages = [(k, f"https://site.example/{k}", SITE.format(k=k, **p)) for k, p in enumerate(parts)]
    # copies of one article, on a host of their own and in number more than half, aren't template
    pages += [(100 + k, f"https://copies.example/{k}", SITE.format(k=k, **parts[0])) for k in range(12)] + [(120 + k, f"https://copies.example/x{k}", SITE.format(k=k, **parts[k])) for k in range(1, 8)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.main_text(df).collect()}
    want = {k: "\n".join(p[n] for n in ("title", "one", "two", "three", "four")) for k, p in enumerate(parts)}
    assert all(got[k] == want[k] for k in want)
    assert all(got[100 + k] == want[0] for k in range(12))
    # without its host a page keeps the template
    alone = {k: html_extract.extract(page, None) for k, _, page in pages[:20]}
    assert all("Subscribe to our letter" in t for t in alone.values())


def test_pages_of_any_depth_and_several_articles(spark):
    deep = [(k, f"https://deep.example/{k}", tag * 30_000 + f"<p>text number {k}") for k, tag in enumerate(("<div>", "<b>", "<ul><li>", "<article><b>"))]
    pages = [*deep, (10, "https://two.example/", "<nav>menu</nav><article><p>short</article><article><h2 id=related-work>Related</h2><p>the longer one of two</article><aside>x</aside>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.main_text(df).collect()}
    assert [got[k] for k in range(4)] == [f"text number {k}" for k in range(4)]
    assert got[10] == "short\nRelated\nthe longer one of two"


def test_short_parts_of_pages_without_an_article_stay(spark):
    """Introductions of 5 to 30 % of the text, in a container of their own, on hosts of six pages; the host's template goes."""
    rng = random.Random(14)
    pages, want = [], {}
    for host, share in enumerate((5, 10, 19, 26, 30)):
        for k in range(6):
            intro, rest = corpus.prose(rng, 2 * share), [corpus.prose(rng, 100 - share) for _ in range(2)]
            parts = [f"<div class=lead><p>{intro}</p></div>", f"<div class=text><p>{rest[0]}</p><p>{rest[1]}</p></div>"]
            lines = [intro, *rest] if k % 2 else [*rest, intro]
            body = "".join(parts if k % 2 else parts[::-1])
            pages.append((10 * host + k, f"https://h{host}.example/{k}", f"<body><div class=top>Our site of things</div><div class=wrap>{body}</div><div class=last>Written by the people of the site</div></body>"))
            want[10 * host + k] = "\n".join(lines)
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.main_text(df).collect()} == want
    # the wrapper and its constants decide: without them the template stays
    assert all(html_extract.extract(page, None) == f"Our site of things\n{want[k]}\nWritten by the people of the site" for k, _, page in pages)


def test_hosts_of_random_trees_equal_brute_force(spark):
    """Sites of random nested containers: what varies stays in page order, what is the same at one place of every page goes."""
    rng = random.Random(15)
    pages, want = [], {}
    for host in range(12):
        number = iter(range(1000))

        def template(depth):
            out = []
            for _ in range(rng.randint(2, 4)):
                n = next(number)
                out.append((n, template(depth - 1) if depth and rng.random() < 0.5 else None, rng.random() < 0.4))
            return out

        site = template(2)
        for k in range(8):
            lines = []

            def build(nodes, k=k, lines=lines, host=host):
                out = ""
                for n, inner, constant in nodes:
                    if inner is None:
                        words = f"fixed words {host} at {n}" if constant else corpus.prose(rng, 8)
                        inner_html = f"<p>{words}</p>"
                        if not constant:
                            lines.append(words)
                    else:
                        inner_html = build(inner)
                    out += f"<div class=p{chr(97 + n % 26)}{chr(97 + n // 26)}>{inner_html}</div>"
                return out

            page = f"<body><div class=top>Site {host} of all</div>{build(site)}<p>{(last := corpus.prose(rng, 6))}</p></body>"
            pages.append((100 * host + k, f"https://r{host}.example/{k}", page))
            want[100 * host + k] = "\n".join([*lines, last])
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.main_text(df).collect()} == want
