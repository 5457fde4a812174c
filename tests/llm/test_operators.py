"""Each operator against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import itertools
import math
import pickle
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash

from tidemark.llm import bpe, decontaminate, html_text, jaccard_join, language_model, licenses, line_dedup, quality, toxicity, url_filter

from .conftest import DOCS, LONG

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACES = " \t\n\x0b\x0c\r"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rows(df):
    return [tuple(r) for r in df.collect()]


def some_docs(spark, n=120, seed=3):
    """Random texts of a small vocabulary, among them copies, near copies and shared lines."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 6))) for _ in range(300)]
    texts = []
    for _ in range(n):
        kind = rnd.random()
        if texts and kind < 0.2:
            texts.append(rnd.choice(texts))
        elif texts and kind < 0.5:
            w = rnd.choice(texts).split(" ")
            for _ in range(rnd.randint(1, 3)):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(rnd.choice(vocabulary) + rnd.choice(["", "", "", ".\n", "!", " %%%"]) for _ in range(rnd.choice((1, 3, 5, 30, 80, 200)))))
    data = list(enumerate(texts))
    return data, spark.createDataFrame(data, "doc_id bigint, text string").repartition(5)


# -- 1
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1><a href=/>Home</a></header>
<nav><ul><li><a href=a>A</a><li><a href=b>B</a></ul></nav><div class="cookie-notice"><p>We use cookies, and more, and more, always.</p></div>
<main><article class="post"><header class="entry-header"><h1>Title &amp; more</h1></header><p>First para, with <a href=x>link</a>, and&nbsp;more
 text, that goes on.<p>Second para<br>goes on, a lot, of text, here.<ul><li>one<li>two</ul><form><label>Mail me, please, often, now</label></form>
<aside>aside text, a b, c</aside><script>if (a<b) {"</p>"}</script><!-- hidden, text --><p>1 &lt; 2 and 3 > 2</p></article>
<section id="comments"><article class=comment><p>I like this, a lot, really, it is good.</p></article></section></main>
<div class="sidebar"><p>Some, side, text, here, with, commas</p></div><footer>foot, note, text, and, commas</footer></body></html>"""


def test_html_keeps_the_article():
    assert html_text.main_text(PAGE).split("\n") == ["Title & more", "First para, with link, and more text, that goes on.", "Second para goes on, a lot, of text, here.", "one", "two", "1 < 2 and 3 > 2"]


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("just text", "just text"), ("<p>a", "a"), ("<div><p>Hello</div><p>b<i", "Hello\nb"), ("<script>x", ""), ("a<!-- b", "a"), ("&#65;&am <p>x &amp y", "A&am\nx & y"), ("<nav>only</nav>", "")])
def test_html_odd_pages(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("start", ['<div class="content has-sidebar">', '<article class="post comments-open">', '<div id="page-with-menu">', '<div class="no-ads">', '<div class="layout--right-sidebar">', '<div class="social-history">', '<form id="aspnetForm">', "<div class=modal>"])
def test_html_words_around_an_article_do_not_veto_it(start):
    article = [f"Paragraph {i} is long, has commas, and goes on for quite a while, as they do in real life." for i in range(8)]
    comments = "<section id=comments>" + "<p>I like this, a lot, really, it is so good.</p>" * 12 + "</section>"
    side = "<div class=sidebar><p>Some, side, text, here, with, commas, and more</p></div>"
    page = f"<body><nav><a href=a>x</a></nav>{start}{''.join(f'<p>{x}</p>' for x in article)}{side}</{start[1:].split()[0].rstrip('>')}>{comments}<footer>foot, note, text, and, commas</footer></body>"
    assert html_text.main_text(page).split("\n") == article


def best_of(tree):
    """Text of the best container by the docstring's rules, ancestor by ancestor; trees of (tag, class, text or children) without links."""
    nodes = []

    def walk(node, path):
        nodes.append((node, path))
        if not isinstance(node[2], str):
            for child in node[2]:
                walk(child, [*path, node])

    walk(tree, [])
    texts = [(n, p) for n, p in nodes if isinstance(n[2], str)]
    worth = {id(n): 0.0 if len(n[2]) < 25 and n[0] != "p" else 1 + n[2].count(",") + min(len(n[2]) / 100, 3) for n, _ in texts}
    out = set()
    live = lambda: [(n, p) for n, p in texts if not out.intersection(map(id, [*p, n]))]
    inside = lambda n: sum(worth[id(t)] for t, p in live() if any(x is n for x in [*p, t]))
    whole, clear = inside(tree), ("sidebar", "comments")
    for names, spare, most in ((clear, html_text.SPARE, whole / (html_text.SPARE + 1)), (clear, html_text.SPARE, whole), (("social-history",), 1, whole)):
        for n, _ in reversed(nodes):
            if n[1] in names and inside(n) <= most and not inside(n) > spare * (inside(tree) - inside(n)) + 1e-9:
                out.add(id(n))
    points, size = Counter(), Counter()
    for n, p in live():
        first = [*p] if n[0] == "p" else [*p, n]
        for x in [*p, n]:
            size[id(x)] += len(n[2])
        for k, x in enumerate(reversed(first)):
            points[id(x)] += worth[id(n)] * html_text.DECAY**k
    held = [(n, p) for n, p in nodes if size[id(n)]]
    if not held:
        return ""
    best, path = max(reversed(held), key=lambda x: (round(points[id(x[0])], 9), size[id(x[0])]))
    kept = {id(best)}
    for n, p in held:
        if p and path and p[-1] is path[-1] and n is not best and (points[id(n)] >= max(3, points[id(best)] / 5) or n[0] == "p" and size[id(n)] > 80):
            kept.add(id(n))
    return "\n".join(n[2] for n, p in live() if kept.intersection(map(id, [*p, n])))


def test_html_against_brute_force():
    rnd = random.Random(12)

    def tree(depth):
        kind = rnd.choice(["", "", "", "social-history", "sidebar", "comments"])
        if depth == 0 or rnd.random() < 0.3:
            return (rnd.choice(["p", "p", "div"]), kind if rnd.random() < 0.3 else "", " ".join(rnd.choice(["word", "text,", "other", "and"]) for _ in range(rnd.choice([1, 4, 12, 40]))))
        return (rnd.choice(["div", "section"]), kind, [tree(depth - 1) for _ in range(rnd.randint(1, 4))])

    def shown(n):
        return f'<{n[0]} class="{n[1]}">' + (n[2] if isinstance(n[2], str) else "".join(map(shown, n[2]))) + f"</{n[0]}>"

    for _ in range(300):
        t = ("section", "", [tree(4) for _ in range(rnd.randint(1, 3))])
        assert html_text.main_text(shown(t)) == best_of(t)


def test_html_deep_and_long_pages():
    assert html_text.main_text("<div class=no-ads><p>text, and more" * 20_000) == "\n".join(["text, and more"] * 20_000)
    assert html_text.main_text("<div>" * 5000 + "deep text" + "</div>" * 5000) == "deep text"
    assert html_text.main_text('<a "' * 5000) is not None
    assert len(html_text.main_text("<article>" + "<p>Text, and more, of it.</p>" * 5000 + "</article>").split("\n")) == 5000


def test_html_rows(spark):
    data = [(1, "u", PAGE, "x"), (1, "u", PAGE, "y"), (2, None, None, "z"), (None, "v", "<p>a b</p>", "")]
    got = rows(html_text.extract(spark.createDataFrame(data, "page_id bigint, url string, html string, text string")))
    assert sorted(got, key=repr) == sorted([(1, "u", html_text.main_text(PAGE), len(html_text.main_text(PAGE)))] * 2 + [(2, None, "", 0), (None, "v", "a b", 3)], key=repr)
    assert rows(html_text.extract(spark.createDataFrame([], "page_id bigint, url string, html string"))) == []


# -- 2
def base(text):
    w = words(text)
    count = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, repeats = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            repeats += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), repeats, len(covered), failed


def test_quality_base_counts(spark, odd_docs):
    data, df = some_docs(spark)
    table = [0.0] * quality.BUCKETS
    for docs, source in ((df, data), (odd_docs, DOCS)):
        got = Counter(r[:7] + (r[7],) for r in rows(quality.judge(docs, table)))
        assert got == Counter((i, *base(t), not base(t)[-1]) for i, t in source)


def test_quality_ratio_tells_junk(spark, no_docs):
    rnd = random.Random(1)
    clean = lambda: " ".join(rnd.choice(["the", "cat", "sat", "on", "mats", "and", "hats"]) for _ in range(80))
    junk = lambda: " ".join(rnd.choice(["xx%%%", "$$$", "zq|", "##buy"]) for _ in range(80))
    data = [(i, clean() if i % 5 else junk()) for i in range(100)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(0, 100, 2)] + [(None, 1), (7, None)], "doc_id bigint, quality int")
    table = quality.ratios(docs, labels)
    assert len(table) == quality.BUCKETS
    ratio = {r["doc_id"]: r["ratio"] for r in quality.judge(docs, table).collect()}
    assert all((ratio[i] > quality.THRESHOLD) == bool(i % 5) for i, _ in data)
    assert quality.ratios(docs, labels.where("quality = 5")) == [0.0] * quality.BUCKETS
    assert rows(quality.judge(no_docs, table)) == []


# -- 3
def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def test_language_model_base_and_order(spark, odd_docs):
    data, df = some_docs(spark)
    for docs, source in ((df, data), (odd_docs, DOCS)):
        tokens = [[*words((t or "").translate(LOWER)), None] for _, t in source]
        c = Counter(w for (i, _), ws in zip(source, tokens, strict=True) if not held(i) for w in ws)
        n, v = sum(c.values()), len(c)
        want = sorted(((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 4)) for (i, _), ws in zip(source, tokens, strict=True)), key=repr)
        out = language_model.score_texts(docs).collect()
        assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in out), key=repr) == want
        assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in out)


def test_language_model_learns(spark, no_docs):
    rnd = random.Random(5)
    data = [(i, " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(60))) for i in range(80)]
    strange = [(10_000 + i, " ".join("".join(rnd.choice("qxzvwk") for _ in range(5)) for _ in range(60))) for i in range(3)]
    fold = [i for i, _ in data if held(i)]
    strange = [(next(k for k in range(10_000 + 50 * j, 20_000) if held(k)), t) for j, (_, t) in enumerate(strange)]
    out = {r["doc_id"]: r["score"] for r in language_model.score_texts(spark.createDataFrame(data + strange, "doc_id bigint, text string")).collect()}
    assert min(out[i] for i in fold) > max(out[i] for i, _ in strange) / 2
    assert rows(language_model.score_texts(no_docs)) == []


def unit_hashes(texts):
    lm = language_model
    return [lm.hashed(lm.units(t), lm.Hashes()) for t in texts]


def trained_mixer(texts, passes=1, leaves=language_model.LEAVES):
    """A state, the counts of one pass, and the code."""
    lm = language_model
    found = unit_hashes(texts)
    c = Counter(u for t in texts for u in lm.units(t))
    code = lm.Code([u for u, _ in c.most_common(leaves)], [*(n for _, n in c.most_common(leaves)), max(1, sum(c.values()) - sum(n for _, n in c.most_common(leaves)))])
    chunks = [lm.Decisions(c, code) for c in lm.chunks(enumerate(found))]
    m = lm.Mixer()
    for _ in range(passes):
        table = np.zeros(2 * lm.STARTS[-1], np.uint32)
        for d in chunks:
            m.learn(d, table)
    return m, table.astype(np.float32), code


def hash_costs(m, table, code, found):
    lm = language_model
    return sum(m.cost(lm.Decisions(c, code), table, len(found)) for c in lm.chunks(enumerate(found)))


def mixer_costs(m, table, code, texts):
    return hash_costs(m, table, code, unit_hashes(texts))


@pytest.mark.parametrize("text", [b"", b" ", b"a", b" a  b ", b"a\nb", b"\n\n a\t\tb \r\n", b"x \n \x0b\x0cy\xc3\xa9", b"\0 a"])
def test_language_model_units_are_the_text(text):
    found = language_model.units(text)
    assert found[-1] == b" " and all(b" " not in u for u in found[:-1])
    spaced = b" ".join(found[:-1])
    for space in (b"\n", b"\t", b"\r", b"\x0b", b"\x0c"):
        spaced = spaced.replace(b" " + space + b" ", space)
    assert spaced == text and [u for u in found if u and not u.isspace()] == text.split()


def test_language_model_is_a_code():
    """Over all next leaves in a context the probabilities sum to one; over the units outside the code, known and spelt, to one or less."""
    lm = language_model
    m, table, code = trained_mixer([b"the then a thin the the then", b"the thin a of"] * 20, leaves=4)
    context = unit_hashes([b"a thin the"])[0][:-1]
    leaves = [xxhash.xxh3_64_intdigest(w) for w in [*code.words, b"any other"]]
    both = hash_costs(m, table, code, [np.append(context, np.uint64(h)) for h in leaves])
    assert (10 ** (both - hash_costs(m, table, code, [context])[0])).sum() == pytest.approx(1, abs=1e-3)
    assert (0.5**code.sizes).sum() == 1 and len(code.sizes) == 5
    words_of = [b"ab", b"a", b"", b"cab", b"abcab", b"bcab"]
    counts, short = lm.letter_counts(words_of), [bytes(w) for k in range(5) for w in itertools.product(b"abc", repeat=k)]
    spelling = lm.Speller(counts).spelt(short)

    def spell(w):
        total, steps = 0.0, [256, 256, 256, *w, 256]
        for i in range(3, len(steps)):
            p = 1 / 257
            for back in (1, 2, 3):
                now = tuple(steps[i - back : i])
                follow = Counter(y[j] for x in words_of for y in [[256, 256, 256, *x, 256]] for j in range(3, len(y)) if tuple(y[j - back : j]) == now)
                p = (follow[steps[i]] + lm.PRIOR * p) / (sum(follow.values()) + lm.PRIOR)
            total += math.log10(p)
        return total

    want = [spell(w) for w in short]
    assert spelling.tolist() == pytest.approx(want) and (10**spelling).sum() < 1
    c = np.array([3.0, 0, 1, *[0] * (len(short) - 3)])
    inside = 10 ** lm.within(c, 4.0, 2.0, spelling)
    assert inside.tolist() == pytest.approx([(x + 2 * 10**s) / 6 for x, s in zip(c, want, strict=True)]) and inside.sum() <= 1
    assert np.isfinite(lm.within(np.zeros(1), 0.0, 1.0, np.array([-5000.0])))[0]


def test_language_model_against_brute_force():
    """Contexts of real counts, the match, gates, mixing and maps, one decision after the other in plain Python."""
    from collections import defaultdict

    lm, rnd = language_model, random.Random(8)
    vocab = [b"sun", b"moon", b"star", b"night", b"a", b"of", b"light"]
    texts = [b" ".join(rnd.choice(vocab) for _ in range(rnd.randrange(1, 40))) for _ in range(200)]
    m, table, code = trained_mixer(texts, leaves=6)
    seen = defaultdict(lambda: [0, 0])

    def path(h):
        b = int(code.leaf(np.array([h], np.uint64))[0])
        at = slice(code.starts[b], code.starts[b] + code.sizes[b])
        return list(zip(code.nodes[at].tolist(), code.bits[at].tolist(), strict=True))

    def steps(t):
        for i, h in enumerate(t):
            for k, (node, y) in enumerate(path(h)):
                near = next(((back, path(t[i - back])) for back in (1, 2, 3) if i >= back and path(t[i - back]) != others), None)
                yield i, k, node, y, [(0, node), (1, str(near), node), (3, tuple(t[max(0, i - 3) : i]), node)]

    others = path(xxhash.xxh3_64_intdigest(b"any other"))
    found = [x.tolist() for x in unit_hashes(texts)]
    for t in found:
        for _, _, _, y, keys in steps(t):
            for key in keys:
                seen[key][y] += 1

    def brute(t):
        total = 0.0
        for i, k, node, y, keys in steps(t):
            n = [seen[key] if key in seen else [0, 0] for key in keys]
            st = [min(12, max(-12, math.log((c1 + 0.02) / (c0 + 0.02)))) for c0, c1 in n]
            level, want = 0, []
            if i >= 1:
                j = next((j for j in range(i - 1, 0, -1) if t[j - 1] == t[i - 1]), None)
                if j is not None:
                    want, level = path(t[j]), 2 if j >= 3 and t[j - 3 : j] == t[i - 3 : i] else 1
            if level and (k >= len(want) or want[k][0] != node):
                level = 0
            st.append((6 * want[k][1] - 3) if level else 0)
            last, bit, row = sum(n[-1]), min(k, 7), min(k, lm.Mixer.ROWS - 1)
            gates = sum(c0 + c1 > 1 for c0, c1 in n) * 8 + bit, (min(15, 1 + int(math.log2(last))) if last else 0) * 8 + bit, level * 8 + bit
            z = max(-11.99, min(11.99, sum(float(w[g, j]) * st[j] for w, g in zip(m.gates, gates, strict=True) for j in range(lm.INPUTS)) / 3))
            x = (z + 12) * (lm.MAPS - 1) / 24
            refined = float(m.maps[row, int(x)]) * (1 - x % 1) + float(m.maps[row, int(x) + 1]) * (x % 1)
            p = min(1 - 1e-7, max(1e-7, (1 / (1 + math.exp(-z)) + 3 * refined) / 4))
            total += math.log10(p if y else 1 - p)
        return total

    some = [*found[:8], *(x.tolist() for x in unit_hashes([b"star of light a star of light a star of light and", b"", b"qq\xc3\xa9 zz"]))]
    # the hashed slots are so many here that the contexts hardly share any
    assert hash_costs(m, table, code, [np.array(t, np.uint64) for t in some]).tolist() == pytest.approx([brute(t) for t in some], rel=0.02)


def test_language_model_scores_texts_alone(monkeypatch):
    """Scores do not depend on the texts beside, nor on how texts are put together in chunks; stretches join without loss of context."""
    rnd = random.Random(3)
    texts = [bytes(rnd.choice(b"abcd ") for _ in range(rnd.randrange(3000))) for _ in range(12)] + [b""]
    m, table, code = trained_mixer(texts)
    alone = [mixer_costs(m, table, code, [t])[0] for t in texts]
    assert mixer_costs(m, table, code, texts).tolist() == pytest.approx(alone)
    found = unit_hashes(texts)[0]
    whole = language_model.Decisions([(0, 0, found)], code)
    monkeypatch.setattr(language_model, "STRETCH", 100)
    cut = [language_model.Decisions(c, code) for c in language_model.chunks([(0, found)])]
    assert (np.concatenate([d.slots for d in cut], axis=1) == whole.slots).all()


def test_language_model_sees_order_and_repetition():
    """Across words, and inside a text: shuffled words and unrepeated texts cost more."""
    rnd = random.Random(4)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(60)]
    nexts = {w: rnd.sample(vocab, 2) for w in vocab}

    def chain(n):
        out = [rnd.choice(vocab)]
        while len(out) < n:
            out.append(rnd.choice(nexts[out[-1]]))
        return out

    state = trained_mixer([" ".join(chain(80)).encode() for _ in range(150)])
    fresh = [chain(80) for _ in range(10)]
    mixed = [rnd.sample(t, len(t)) for t in fresh]
    real, shuffled = (mixer_costs(*state, [" ".join(t).encode() for t in ts]).sum() for ts in (fresh, mixed))
    assert real > 0.7 * shuffled

    def line():
        return " ".join(rnd.choice(vocab) for _ in range(20)) + "\n"

    state = trained_mixer([(line() * 3).encode() for _ in range(2000)])
    new = line()  # in no training text
    once, twice = (mixer_costs(*state, [(new * k).encode()])[0] for k in (1, 2))
    assert twice > 1.4 * once


def lm_blocks(monkeypatch, parts):
    """Blocks of texts, one for each part, as the passes over them read them."""
    lm, out = language_model, []
    for k, part in enumerate(parts):
        monkeypatch.setattr(lm, "TaskContext", SimpleNamespace(get=lambda k=k: SimpleNamespace(partitionId=lambda: k)))
        ids = [i for i, _ in part]
        out += lm._blocks(iter([pa.record_batch([pa.array(ids), pa.array([held(i) for i in ids]), pa.array([t for _, t in part])], names=["doc_id", "held_out", "text"])]))
    return out


def dealt(batches):
    """The rows of each dest as one task gets them."""
    found = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["dest"])
    return [pa.Table.from_pylist(list(g)).to_batches() for _, g in itertools.groupby(found, key=lambda r: r["dest"])]


def test_language_model_code_of_the_most_frequent_units_of_all(monkeypatch):
    """A unit that 17,000 units of each block outnumber is in the code when it is more frequent over all blocks."""
    lm = language_model
    free = [i for i in range(100) if not held(i)]
    parts = [[(free[k], " ".join([*(f"{chr(97 + k)}{i}" for i in range(17_000) for _ in range(2)), "common"]))] for k in range(3)]
    tasks = dealt(lm._unit_rows(4)(iter(lm_blocks(monkeypatch, parts))))
    assert len(tasks) == 4
    known = [r for task in tasks for b in lm._known(iter(task)) for r in b.to_pylist()]
    c = Counter(w.encode() for p in parts for _, t in p for w in t.split()) + Counter({lm.END: 3})
    want = sorted(c.items(), key=lambda x: (-x[1], x[0]))[: lm.LEAVES]
    assert lm._top([r["payload"] for r in known if r["kind"] == 3]) == want and (b"common", 3) in want


def test_language_model_contexts_share_nothing(monkeypatch):
    """Counts after the last three units are exact over all blocks, and each context of a frequent unit has slots of its own."""
    lm, rnd = language_model, random.Random(12)
    monkeypatch.setattr(lm, "EVENTS", 300)
    vocab = [f"w{i}" for i in range(9)]
    texts = [(i, " ".join(rnd.choice(vocab[: rnd.choice([2, 9])]) for _ in range(rnd.randrange(40)))) for i in range(150)]
    blocks = lm_blocks(monkeypatch, [texts[:70], texts[70:]])
    code = lm.Code([*(w.encode() for w in vocab[:5]), lm.END], [50, 40, 30, 20, 10, 5, 60])

    def path(u):
        b = int(code.leaf(np.array([xxhash.xxh3_64_intdigest(u)], np.uint64))[0])
        return [(int(code.nodes[code.starts[b] + k]), int(code.bits[code.starts[b] + k])) for k in range(code.sizes[b])]

    seen = Counter()
    for i, t in texts:
        of = lm.units(t.encode())
        for k, u in enumerate(of):
            if not held(i):
                seen.update((tuple(of[max(0, k - 3) : k]), node, y) for node, y in path(u))
    answers = [r for task in dealt(lm._event_rows(3, code)(iter(blocks))) for b in lm._follow(code)(iter(task)) for r in b.to_pylist()]
    for b, part in zip(blocks, (texts[:70], texts[70:]), strict=True):
        row = b.to_pylist()[0]
        parts = [r["payload"] for r in sorted(answers, key=lambda r: r["dest"]) if r["block"] == row["block"]]
        words = lm.pack(lm.planes(np.zeros(0, np.int64)), lm.planes(np.zeros(0, np.int64)), lm.planes(np.zeros(0, np.int64)))
        joined = [np.array([len(x), *map(len, x)], np.int64).tobytes() + b"".join(x) for x in ([words], parts)]
        block = lm.Joined(row["payload"], *joined)
        exact = block.followers(code)
        d = lm.Decisions([(k, 0, block.numbers[a : a + n]) for k, (a, n) in enumerate(zip(exact.starts, block.sizes, strict=True))], code, exact)
        want = [(seen[c, node, 1], seen[c, node, 0]) for _, t in part for of in [lm.units(t.encode())] for k, u in enumerate(of) for c in [tuple(of[max(0, k - 3) : k])] for node, y in path(u)]
        assert d.seen[0].tolist() == pytest.approx([math.log((c1 + 0.02) / (c0 + 0.02)) for c1, c0 in want], abs=1e-5)
        assert d.seen[1].tolist() == [(c1 + c0).bit_length() for c1, c0 in want]
    many = [str(i).encode() for i in range(lm.LEAVES)]
    code = lm.Code(many, [*range(1, lm.LEAVES + 1), 1])
    order = [rnd.choice(many) for _ in range(200_000)]
    d = lm.Decisions([(0, 0, lm.hashed(order, lm.Hashes()))], code)
    keys = {(before, node) for before, u in zip([None, *order], order, strict=False) for node, _ in path(u)}
    assert len(np.unique(d.slots[1])) == len(keys)


def test_language_model_numbers_units_without_a_lookup_each(monkeypatch):
    """Blocks hold units() of each text, cut where they are full, for less time than one lookup a unit takes."""
    lm, rnd = language_model, random.Random(14)
    odd = ["", None, " ", "  ", " a", "a ", "a\n\nb\tc\r\nd", "\n", "x\x0b\x0cy \u00e9\u6f22  z", "\x00 \x00a", "\x1c", *("".join(rnd.choice("ab \n\t") for _ in range(rnd.randrange(30))) for _ in range(300))]
    monkeypatch.setattr(lm, "BLOCK_BYTES", 500)
    for data in ([(i, t) for i, t in enumerate(odd)], [(5, None), (None, "")]):
        found, sizes = [], []
        for r in [r for b in lm_blocks(monkeypatch, [data]) for r in b.to_pylist()]:
            block, at = lm.Block(r["payload"]), 0
            assert sorted(set(block.numbers.tolist())) == list(range(len(block.words)))
            for i, known, flag, n in zip(block.ids.tolist(), block.known.tolist(), block.flags.tolist(), block.sizes.tolist(), strict=True):
                found.append((i if known else None, bool(flag), [block.words[k] for k in block.numbers[at : at + n]]))
                at += n
            sizes.append([sum(len((t or "").encode()) + 1 for _, t in data[len(found) - len(block.sizes) : len(found) - less]) for less in (0, 1)])
        assert found == [(i, held(i), lm.units((t or "").encode())) for i, t in data]
        assert all(x >= 500 for x, _ in sizes[:-1]) and all(x < 500 for _, x in sizes)
    texts = [" ".join(f"w{rnd.randrange(20_000)}" for _ in range(300)) for _ in range(500)]

    def plain():
        numbers = {}
        return [[numbers.setdefault(u, len(numbers)) for u in lm.units(t.encode())] for t in texts]

    def seconds(run):
        start = time.process_time()
        run()
        return time.process_time() - start

    array = pa.array(texts)
    assert min(seconds(lambda: lm.numbered(array)) for _ in range(5)) < min(seconds(plain) for _ in range(5))


def test_language_model_tables_arrive_in_parts(spark, monkeypatch):
    """A table that is sent is what it was, with a part of it unpacked at once; batches are limited while passes run, and not after."""
    lm, rng = language_model, np.random.default_rng(2)
    table = (rng.integers(0, 5, 2 * 12_345) * rng.integers(0, 900, 2 * 12_345)).astype(np.float32)
    whole, sizes, made = lm.Stretched(table), [], lm.Stretched.__init__
    monkeypatch.setattr(lm.Stretched, "__init__", lambda self, part: (sizes.append(len(part)), made(self, part))[1])
    assert (pickle.loads(pickle.dumps(lm.Counts(table, lm.Stretched.joined))).table.stretched == whole.stretched).all()
    assert max(sizes) <= 2 * (12_345 // lm.SLICES + 1)
    assert (pickle.loads(pickle.dumps(lm.Counts(table[:-1]))).table == table[:-1]).all()
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    with lm._freed(spark):
        assert int(spark.conf.get(key)) == lm.BATCH_BYTES
    assert spark.conf.get(key) == before


def test_language_model_decisions_of_numbers_and_of_hashes(monkeypatch):
    """With exact counts the match looks at units' numbers, and scores do not depend on how many units are worked on at once."""
    lm, rnd = language_model, random.Random(15)
    monkeypatch.setattr(lm, "PIECE_UNITS", 7)
    vocab = [f"w{i}" for i in range(30)]
    texts = [(i, " ".join(rnd.choice(vocab[: rnd.choice([3, 30])]) for _ in range(rnd.randrange(80)))) for i in range(60)]
    (batch,) = lm_blocks(monkeypatch, [texts])
    code = lm.Code([*(w.encode() for w in vocab[:12]), lm.END], [*range(5, 17), 8, 60])
    answers = [r["payload"] for task in dealt(lm._event_rows(3, code)(iter([batch]))) for b in lm._follow(code)(iter(task)) for r in b.to_pylist()]
    words = lm.pack(*(lm.planes(np.zeros(0, np.int64)) for _ in range(3)))
    block = lm.Joined(batch.to_pylist()[0]["payload"], *(np.array([len(x), *map(len, x)], np.int64).tobytes() + b"".join(x) for x in ([words], answers)))
    exact = block.followers(code)
    monkeypatch.setattr(lm, "STRETCH", 50)
    of = [(k, block.numbers[a : a + n]) for k, (a, n) in enumerate(zip(exact.starts.tolist(), block.sizes.tolist(), strict=True))]
    hashes = unit_hashes([t.encode() for _, t in texts])
    costs, table = [], lm.Stretched(np.random.default_rng(1).integers(0, 9, 2 * lm.STARTS[2]).astype(np.float32))
    for units in (40, 10_000):
        both = zip(lm.chunks(iter(of), units), lm.chunks(enumerate(hashes), units), strict=True)
        pairs = [(lm.Decisions(a, code, exact), lm.Decisions(b, code)) for a, b in both]
        for a, b in pairs:
            assert a.again.tolist() == b.again.tolist() and a.expects.tolist() == b.expects.tolist()
            assert (a.slots == b.slots[:2]).all() and (a.gate % 24 == b.gate % 24).all()
        assert sum(len(a.again) for a, _ in pairs) > 500
        costs.append(sum(lm.Mixer().cost(a, table, len(texts)) for a, _ in pairs))
    assert costs[0].tolist() == pytest.approx(costs[1].tolist())


# -- 4
def test_decontamination(spark, odd_docs, no_docs):
    rnd = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(text(n))) for k, n in enumerate((1, 3, 5, 6, 7, 11, 15, 22, 40, 59, 130, 700))]
    data = []
    for k, (_, item) in enumerate(items):
        for shift in range(9):
            data.append((1000 * k + shift, " ".join([*text(20 + shift), item.upper() + ".", *text(30)])))
    data += [(50_000 + i, " ".join(text(300))) for i in range(40)]
    near = items[9][1].split()
    near[0], near[-1] = "zz", "zz"
    data += [(60_000, " ".join([*text(13), *near, *text(9)])), (60_001, " ".join(text(20_000) + items[8][1].split() + text(20_000)))]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    benchmark = spark.createDataFrame([*items, (99, None), (98, " ")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, benchmark).collect()}
    planted = {(d, d // 1000) for d, _ in data if d < 50_000} | {(60_000, 9), (60_001, 8)}
    assert planted <= got
    by = dict(data)
    for d, i in got - planted:  # items of a word or three may stand elsewhere by chance
        assert " ".join(dict(items)[i].split()) in " ".join(by[d].split())
    whole = spark.createDataFrame(items[4:], "item_id bigint, text string")
    assert sorted(r["doc_id"] for r in decontaminate.keep_clean(docs, whole).collect()) == sorted(d for d, _ in data if d < 4000 or 50_000 <= d < 60_000)
    assert decontaminate.keep_clean(odd_docs, benchmark).columns == odd_docs.columns
    assert decontaminate.keep_clean(odd_docs, benchmark).count() == len(DOCS)
    assert rows(decontaminate.leaks(no_docs, benchmark)) == [] and rows(decontaminate.leaks(odd_docs, benchmark.where("item_id < 0"))) == []


def test_decontamination_finds_every_near_copy():
    """Near copies that lost their start, or with words changed, put in or left out: against all starts of all items."""
    rnd = random.Random(6)
    text = lambda n: [f"w{rnd.randrange(300)}" for _ in range(n)]
    items = [(k, text(n)) for k, n in enumerate((3, 5, 9, 18, 22, 27, 30, 48, 55, 60, 120, 200))]
    items.append((len(items), (items[5][1][:9] * 4)[:34]))  # equal shingles
    texts = [[], ["w1"]]
    for _, w in items:
        n = len(w)
        cut = max(1, n // 12)
        mid = n // 2
        for near in (w[cut:], w[:-cut], w[:mid] + ["zz"] + w[mid + 1 :], w[:mid] + ["zz"] + w[mid:], w[: mid - 1] + w[mid:], ["zz"] * cut + w[cut:]):
            texts += [text(rnd.randrange(30)) + near + text(rnd.randrange(30)), near]
    index = decontaminate.Index([(k, " ".join(w)) for k, w in items])
    got = {(t, i): (a, s) for t, i, a, s in index.search([" ".join(w) for w in texts], 0.8)}
    import numpy as np

    want = {}
    for t, w in enumerate(texts):
        h = np.fromiter(map(index.known.__getitem__, (x.encode() for x in w)), np.uint64, len(w))
        for (i, words_of), shingles in zip(items, index.shingles, strict=True):
            n = len(words_of)
            found = [(-decontaminate.similarity(shingles, decontaminate._shingles(h[max(0, a) : a + n])), max(0, a)) for a in range(1 - n, len(h))]
            if found and -min(found)[0] >= 0.8:
                want[t, i] = min(found)[1], -min(found)[0]
    assert len(want) > 80 and got == want


def test_fingerprints_alone_find_near_copies():
    """Whole items are fingerprinted: edits at the front, in the middle, at the tail and scattered, in items of 15 to 10,000 words."""
    rnd = random.Random(4)
    word = lambda: f"c{rnd.randrange(40)}" if rnd.random() < 0.5 else f"w{rnd.randrange(3000)}"
    text = lambda n: [word() for _ in range(n)]
    items = [(k, text(n)) for k, n in enumerate((15, 18, 22, 27, 34, 35, 48, 49, 60, 100, 200, 400, 448, 451, 800, 2000, 6000, 10_000))]
    rows = [(k, " ".join(w)) for k, w in items]
    alone, whole = decontaminate.Index(rows, exact=False), decontaminate.Index(rows)
    texts, owner = [], []
    for k, w in items:
        n = len(w)
        for share in (0.02, 0.05, 0.1):
            m = max(1, int(n * share))
            a = rnd.randrange(n - m + 1)
            scattered = [x if rnd.random() > 1 / 50 else word() for x in w]
            less = [x for x in w if rnd.random() > 1 / 60]
            for near in (text(m) + w[m:], w[:-m] + text(m), w[:a] + text(m) + w[a + m :], scattered, less, w):
                texts.append(" ".join(text(rnd.randrange(60)) + near + text(rnd.randrange(60))))
                owner.append(k)
    found, want = ({(t, i) for t, i, _, _ in x.search(texts, 0.8) if owner[t] == i} for x in (alone, whole))
    assert len(want) > 220 and found <= want and len(found) >= 0.97 * len(want)
    assert all((t, i) in found for t, i in enumerate(owner) if t % 6 == 5)  # whole copies


def test_decontamination_in_slices(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SLICE_WORDS", 30)
    items = [(k, " ".join(f"i{k}w{j}" for j in range(12))) for k in range(10)]
    docs = spark.createDataFrame([(k, f"before {t} after") for k, t in items], "doc_id bigint, text string")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, benchmark).collect()} == {(k, k) for k in range(10)}
    assert decontaminate.keep_clean(docs, benchmark).count() == 0


def test_every_fingerprint_within_the_radius_is_found():
    import numpy as np

    index = decontaminate.Index([(k, " ".join(f"v{k * 7 + j}" for j in range(30))) for k in range(60)])
    key = next(iter(index.prints))
    prints = index.prints[key][0]
    rnd = np.random.default_rng(0)
    x = prints[rnd.integers(0, len(prints), 3000)].copy()
    for i in range(len(x)):
        for b in rnd.choice(64, rnd.integers(0, 12), replace=False):
            x[i] ^= np.uint64(1) << np.uint64(b)
    w, f = index.near(x, key)
    want = {(i, j) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(prints ^ x[i]) <= decontaminate.RADIUS).tolist()}
    assert set(zip(w.tolist(), f.tolist(), strict=True)) == want


# -- 5
def cut_lines(source, min_docs=3):
    key = lambda line: line.strip(SPACES).translate(LOWER)
    held_by = defaultdict(set)
    for i, t in source:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 20:
                held_by[key(line)].add(i)
    gone = {k: max(v) for k, v in held_by.items() if len(v) >= min_docs}
    out = []
    for i, t in source:
        lines = (t or "").split("\n")
        keep = [x for x in lines if i is None or i >= gone.get(key(x), i)]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (4, 2), (7, 3)])
def test_line_dedup(spark, odd_docs, batches, fanout):
    rnd = random.Random(8)
    pool = [f"{'A' if i % 3 else ''} shared line number {i} with some words" for i in range(40)] + ["short", ""]
    data = [(rnd.randint(0, 50), "\n".join(rnd.choice(pool) + rnd.choice(["", " ", "\t"]) for _ in range(rnd.choice((0, 1, 5, 150))))) for _ in range(60)]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    for docs, source in ((df, data), (odd_docs, DOCS)):
        out = line_dedup.dedup_lines(docs, batches=batches, fanout=fanout)
        assert out.columns[:-1] == docs.columns or "_lines" in docs.columns
        got = [(r[0], r[-1]["n_lines"], r[-1]["n_dropped"], r[1] or "") for r in out.collect()]
        assert Counter(got) == Counter(cut_lines(source))


def test_line_dedup_of_hot_lines(spark, monkeypatch):
    """Lines of very many documents are cut like all others, without meeting in one task."""
    monkeypatch.setattr(line_dedup, "HOT_ROWS", 20)
    data = [(i, f"the line that every text here holds\nanother line of number {i % 30} in some\nown line of the text with number {i}") for i in range(90)]
    out = line_dedup.dedup_lines(spark.createDataFrame(data, "doc_id bigint, text string"))
    assert Counter((r[0], r[-1]["n_lines"], r[-1]["n_dropped"], r[1]) for r in out.collect()) == Counter(cut_lines(data))
    assert "BroadcastHashJoin" in out._jdf.queryExecution().toString()


def test_line_dedup_of_nothing(no_docs):
    assert rows(line_dedup.dedup_lines(no_docs)) == []


def test_runs_compact_by_level(spark):
    runs = line_dedup.LineRuns(spark, min_docs=2, fanout=2)
    for i in range(5):
        runs.add(spark.createDataFrame([(7, 7, 10 - i), (i, 0, 10 - i)], "h1 bigint, h2 bigint, doc bigint"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert [(r["h1"], r["h2"], r["top"]) for r in runs.settled().collect()] == [(7, 7, 10)]
    # once settled by two larger documents, a key adds nothing more
    assert sum(r["n"] for r in runs._read([p for x in runs.levels for p in x]).where("h1 = 7").collect()) == 2


# -- 6
def test_url_rules(spark):
    urls = ["http://a.com/en/1", "HTTPS://WWW.Example.COM/en/7x?q#f", "http://example.com/en/8", "http://notcom/en/", "http://com/en/", "http://x.net/de/8", "http://b.example.net/de/89", "http://org?x", "http://a.org/es/", "ftp://u@a.com:80/en/", "nothing", None, "://", "http://a.com", "http://x.net/de/#://y", "http://" + "a." * 5000 + "com/en/"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(0, urls[0], "y")], "page_id bigint, url string, rule string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(df).collect()}
    assert url_filter.filter_urls(df).count() == len(urls) + 1
    want = {0: ("com/en/", "block"), 1: ("example.com/en/7", "allow"), 2: ("com/en/", "block"), 4: ("com/en/", "block"), 5: ("net/de/", "allow"), 6: ("example.net/de/8", "block"), 8: ("org/es/", "block"), 14: ("net/de/", "allow"), 15: ("com/en/", "block")}
    assert got == {i: want.get(i, (None, "allow")) for i in range(len(urls))}
    assert url_filter.split_url("http://H.com?a/b#c") == ("h.com", "") and url_filter.split_url(None) == ("", "")
    assert rows(url_filter.filter_urls(df.where("page_id < 0"))) == []


def test_url_digest_collisions_are_told_apart(monkeypatch):
    import numpy as np

    monkeypatch.setattr(url_filter, "digest", lambda key: 5)
    rules = url_filter.DigestRules(np.frombuffer(url_filter.rules_file(url_filter.RULES), np.uint8))
    assert url_filter.probe(rules, ["http://a.org/es/1", "http://a.org/xx/1"]) == [("a.org", "/es/1", "org/es/", "block"), ("a.org", "/xx/1", None, None)]


def test_url_many_rules_against_brute_force(spark):
    rnd = random.Random(2)
    rules = [(rnd.choice(["block", "allow"]), f"{'Sub.' if k % 3 else ''}h{k % 40_000}.org", rnd.choice(["", "/", "/a", "/ü/", f"/p{k % 7}"])) for k in range(100_000)]
    assert len(url_filter.rules_file(rules)) < 10_000_000 and len(url_filter.rules_file([])) > 0
    urls = [f"http://{rnd.choice(['', 'x.', 'sub.', 'a.b.'])}h{rnd.randrange(45_000)}.ORG{rnd.choice(['', '/', '/ab', '/ü/z', '/p3/q'])}" for _ in range(400)]
    by = {}
    for v, h, p in rules:
        by[h.lower() + p] = (v, h.lower(), p)
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    for r in url_filter.filter_urls(df, rules).collect():
        labels = r["host"].split(".")
        fits = [(len(h + p), len(h), h + p, v) for k in range(len(labels)) for p in ("", "/", "/a", "/ü/", *[f"/p{j}" for j in range(7)]) if (found := by.get((h := ".".join(labels[k:])) + p)) and r["path"].startswith(p) and found[1:] == (h, p) for v in [found[0]]]
        assert (r["rule"], r["verdict"]) == (max(fits)[2:] if fits else (None, "allow"))
    assert {r["verdict"] for r in url_filter.filter_urls(df, []).collect()} == {"allow"}


# -- 7
def places(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    starts, labels = [], set()
    for label, is_base, template, _ in licenses.TEMPLATES:
        p = template.split()
        for i in range(len(w) - len(p) + 1):
            if is_base and w[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_license_scan(spark, odd_docs):
    texts = ["Under the MIT License under the mit-license; cc by nc cc by nc CC-BY-NC-SA x", "éunder the mit license", "under the mit licenseé", "mit " * 3000 + "under the mit license", "Apache License, Version 2.0 or apache license version 3", "---", "under the MİT license", "cc by cc by nc", "under the mit"]
    data = list(enumerate(texts))
    for docs, source in ((spark.createDataFrame(data, "doc_id bigint, text string"), data), (odd_docs, DOCS)):
        assert Counter(r[:6] for r in rows(licenses.scan(docs))) == Counter((i, *places(t)) for i, t in source)


def test_license_templates(spark):
    long = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and something else"
    df = spark.createDataFrame([(1, long), (2, "GNU General Public License, version 3."), (3, "redistribution and use"), (4, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["labels"], r["base_labels"], r["score"]) for r in licenses.scan(df).collect()}
    assert got[1][:2] == ("mit", "") and 0.5 < got[1][2] < 0.7
    assert got[2] == ("gpl-3", "", 1.0) and got[3] == ("", "", 0.0) and got[4] == ("", "", 0.0)


# -- 8
def linked(source, n, t):
    sets = []
    for _, text in source:
        w = words((text or "").translate(LOWER))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    up = list(range(len(source)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and both * t.denominator >= t.numerator * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(source):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(s), least.get(find(k), i) if s else i) for k, ((i, _), s) in enumerate(zip(source, sets, strict=True))]


@pytest.mark.parametrize(("n", "t", "seed"), [(4, Fraction(85, 100), 1), (5, Fraction(4, 5), 2), (2, Fraction(1, 2), 3)])
def test_jaccard_components(spark, odd_docs, n, t, seed):
    data, df = some_docs(spark, seed=seed)
    for docs, source in ((df, data), (odd_docs, DOCS)):
        assert Counter(rows(jaccard_join.join_components(docs, n, t))) == Counter(linked(source, n, t))


def test_jaccard_chain_of_near_copies(spark):
    """Each text links with its neighbours only; copies of copies make one component without a pivot that reaches all."""
    base_words = [f"b{i}" for i in range(120)]
    data = [(100 - k, " ".join(f"x{i}" if i < 4 * k else w for i, w in enumerate(base_words))) for k in range(25)]
    got = rows(jaccard_join.join_components(spark.createDataFrame(data, "doc_id bigint, text string"), 4, Fraction(85, 100)))
    assert Counter(got) == Counter(linked(data, 4, Fraction(85, 100))) and len({r[2] for r in got}) == 1


def test_jaccard_every_link_is_counted(spark, odd_docs, no_docs):
    """Links within a component beyond those to its pivot, and rows of equal sets."""
    data, df = some_docs(spark, seed=4)
    base_words = [f"b{i}" for i in range(120)]
    near = [(1000 + k, " ".join(f"x{k}" if i == 9 * k else w for i, w in enumerate(base_words))) for k in range(12)]
    data = [*data, *near, (2000, near[3][1].upper())]
    for docs, source in ((spark.createDataFrame(data, "doc_id bigint, text string"), data), (odd_docs, DOCS)):
        sets = []
        for _, text in source:
            w = words((text or "").translate(LOWER))
            sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
        pairs = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
        n_links = Counter(x for p in pairs for x in p)
        got, links = jaccard_join.join_links(docs, 4, Fraction(85, 100))
        assert Counter(rows(got.drop("sig"))) == Counter((*r, n_links[k]) for k, r in enumerate(linked(source, 4, Fraction(85, 100))))
        assert links.count() == len({frozenset((frozenset(sets[a]), frozenset(sets[b]))) for a, b in pairs if sets[a] != sets[b]})
        for block in (jaccard_join.BLOCK_HASHES, 300):  # all of a component in one task, or a few texts
            assert Counter(rows(jaccard_join.join_counts(docs, 4, Fraction(85, 100), block).drop("sig"))) == Counter(rows(got.drop("sig")))
    assert rows(jaccard_join.join_links(no_docs)[0]) == []
    assert rows(jaccard_join.join_counts(no_docs)) == []


@pytest.mark.parametrize("t", [Fraction(85, 100), Fraction(1, 2)])
def test_jaccard_partners_are_all_links(t):
    """Within one block and between two, against all pairs; prefixes by (frequency, hash) as the operator cuts them."""
    rnd, num, den = random.Random(7), t.numerator, t.denominator
    base_set = rnd.sample(range(10**6), 60)
    sets = [np.array(sorted({*(h for h in base_set if rnd.random() < keep), *rnd.sample(range(10**6), rnd.randrange(1, 6))}), np.uint64) for keep in [1.0, 0.97, 0.9, 0.7] * 20]
    frequency = Counter(int(h) for s in sets for h in s)
    rows_of = []
    for s in sets:
        shared = sorted((frequency[int(h)], int(h)) for h in s if frequency[int(h)] > 1)
        alone = len(s) - len(shared)
        bins = np.bincount([h % 32 for _, h in shared], minlength=32).astype(np.int32)
        rows_of.append((len(s), alone, np.array([h for _, h in shared][: max(1, len(s) - -(-num * len(s) // den) + 1 - alone)], np.int64), bins, np.array(sorted(h for _, h in shared), np.uint64)))
    rows_of = [r for r in rows_of if len(r[4]) >= -(-num * r[0] // den)]
    rows_of.sort(key=lambda r: r[0])
    n, alone = (np.array([r[i] for r in rows_of], np.int64) for i in (0, 1))
    for side in (np.zeros(len(n), np.int64), np.arange(len(n)) % 2):
        got = {(x, int(y)) for x, ys in jaccard_join.partners(n, side, alone, [r[2] for r in rows_of], np.stack([r[3] for r in rows_of]), [r[4] for r in rows_of], num, den, bool(side.any())) for y in ys}
        both = lambda a, b: len({*a[4].tolist()} & {*b[4].tolist()})
        want = {(a, b) for a in range(len(n)) for b in range(a + 1, len(n)) if (side[a] != side[b] or not side.any()) and both(rows_of[a], rows_of[b]) * den >= num * (n[a] + n[b] - both(rows_of[a], rows_of[b]))}
        assert got == want and len(want) > 200


def test_jaccard_pairs_of_one_hash_are_those_in_reach(spark):
    """Against all pairs; texts whose shared part is too small meet nobody."""
    rnd = random.Random(3)
    rows_of = [(k, n := rnd.choice([5, 20, 100, 118, 130]), rnd.randint(0, n // 5), h) for h in (1, 2) for k in range(40)] + [(k, 100, 13, 3) for k in range(200)]
    postings = spark.createDataFrame(rows_of, "sig bigint, n int, at int, hash bigint")
    got = jaccard_join._all_pairs(postings, 17, 20).selectExpr("l.hash", "least(l.sig, r.sig)", "greatest(l.sig, r.sig)").collect()
    fits = lambda x, y: 100 * min(x[1], y[1]) >= 85 * max(x[1], y[1]) and 37 * min(x[1] - x[2], y[1] - y[2]) >= 17 * (x[1] + y[1])
    want = [(x[3], x[0], y[0]) for x in rows_of for y in rows_of if x[3] == y[3] and x[0] < y[0] and fits(x, y)]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 60 and all(h != 3 for h, _, _ in want)


def test_jaccard_representatives(spark, odd_docs, no_docs):
    kept = jaccard_join.keep_representatives(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, _ in DOCS)
    twins = spark.createDataFrame([(5, "a b c d e f"), (3, "A b c d e  f"), (4, "z")], "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in jaccard_join.keep_representatives(twins).collect()) == [3, 4]
    assert rows(jaccard_join.join_components(no_docs)) == []


# -- 9
def test_toxicity(spark, odd_docs, no_docs):
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(200)]
    bad = ["stinker", "dolt", "stinkers"]
    data = [(i, " ".join([rnd.choice(vocabulary) for _ in range(60)] + ([rnd.choice(bad)] if i % 4 == 0 else []))) for i in range(500)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(500)] + [(3, None), (None, 1), (8, 0)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    out = toxicity.score(docs, model).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    fold = [r for r in out if r["held_out"]]
    assert sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in fold) >= 0.97 * len(fold)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    # labels of the held-out fold change nothing
    changed = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - toxic, toxic) as toxic")
    again = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.train(docs, changed)).collect()}
    assert all(again[r["doc_id"]] == pytest.approx(r["score"]) for r in out)
    odd = toxicity.score(odd_docs, model).collect()
    assert len(odd) == len(DOCS) and all(0 <= r["score"] <= 1 for r in odd)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in out)
    assert rows(toxicity.score(no_docs, model)) == []


def test_toxicity_fit_against_one_machine(spark):
    """Log-count ratios from sets of n-grams, and the descent over a dense matrix, give the weights of the distributed fit."""
    import numpy as np

    rnd = random.Random(7)
    data = [(i, " ".join(rnd.choice(["aa", "bb", "cc"]) for _ in range(5)) + " dolt" * (i % 3 == 0)) for i in range(60)]
    docs = spark.createDataFrame([*data, (None, "dolt dolt")], "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in data], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels, rounds=5)
    own = [(i % 3 == 0, set(toxicity.features(t).tolist())) for i, t in data if zlib.crc32(str(i).encode()) % 5]
    n = [sum(not y for y, _ in own), sum(y for y, _ in own)]
    held_by = {f: [sum(f in x for y, x in own if y == k) for k in (False, True)] for _, x in own for f in x}
    names = sorted(held_by)
    r = np.array([math.log((held_by[f][1] + 1) / (n[1] + 1)) - math.log((held_by[f][0] + 1) / (n[0] + 1)) for f in names])
    error = np.array([math.sqrt(1 / (held_by[f][1] + 1) + 1 / (held_by[f][0] + 1)) for f in names])
    r = np.where((np.array([sum(held_by[f]) for f in names]) >= 3) & (abs(r) >= 3 * error), r, 0.0)
    assert 5 < np.count_nonzero(r) < len(r)
    x = np.array([[f in own_x for f in names] for _, own_x in own]) * r
    y, each = np.array([k for k, _ in own], float), np.array([0.5 / n[int(k)] for k, _ in own])
    w, b, gw, gb = np.zeros(len(r)), 0.0, np.full(len(r), 1e-8), 1e-8
    for _ in range(5):
        e = (1 / (1 + np.exp(-(x @ w + b))) - y) * each
        g, shift = x.T @ e + 3e-3 * w, e.sum()
        gw, gb = gw + g * g, gb + shift**2
        w, b = w - 0.5 * g / np.sqrt(gw), b - 0.5 * shift / np.sqrt(gb)
    assert np.allclose(model.weights[names], w * r, atol=1e-3) and model.intercept == pytest.approx(b, abs=1e-3)
    assert np.count_nonzero(model.weights) == np.count_nonzero(w * r)
    assert [s["held_out"] for s in toxicity.score(docs, model).where("doc_id is null").collect()] == [False]


def test_toxicity_without_labels(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert all(r["score"] == pytest.approx(0) for r in toxicity.score(odd_docs, toxicity.train(odd_docs, none)).collect())
    clean = spark.createDataFrame([(1, 0)], "doc_id bigint, toxic int")
    assert toxicity.score(odd_docs, toxicity.train(odd_docs, clean)).where("predicted = 1").count() == 0


# -- 10
def test_bpe_round_trip(spark, odd_docs, no_docs):
    data, df = some_docs(spark)
    enc = bpe.encoding(bpe.VOCABULARY)
    for docs, source in ((df, data), (odd_docs, DOCS)):
        want = Counter()
        for i, t in source:
            ids = enc.encode_ordinary(t or "")
            want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
        assert Counter(rows(bpe.digests(docs))) == want
        encoded = bpe.encode(docs)
        assert Counter((r["doc_id"], tuple(r["ids"])) for r in encoded.collect()) == Counter((i, tuple(enc.encode_ordinary(t or ""))) for i, t in source)
        assert Counter((r["doc_id"], bytes(r["raw"])) for r in bpe.decode(encoded).collect()) == Counter((i, (t or "").encode()) for i, t in source)
    assert rows(bpe.digests(no_docs)) == []


def test_bpe_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 500)
    data, df = some_docs(spark, n=60)
    enc = bpe.encoding(bpe.VOCABULARY)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in bpe.encode(df).collect()) == Counter((i, tuple(enc.encode_ordinary(t))) for i, t in data)


def test_bpe_pieces_are_the_pattern():
    import public_tokenizers

    assert bpe.splitter().pattern == public_tokenizers.PATTERN
    assert "".join(regex.findall(public_tokenizers.PATTERN, LONG)) == LONG
