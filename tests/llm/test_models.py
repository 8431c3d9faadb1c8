"""Chat formatting, page texts, neighbours, toxicity and the language model against brute force or held-out accuracy."""

from __future__ import annotations

import hashlib
import html
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from busvitals.llm import chat, html_content, kneser_ney, lsh_forest, toxicity
from busvitals.llm.tokens import ids
from tests.llm.tables import documents

FOLDER = "/root/testdata/sf0.01"

# chat

TURNS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "### user: </turn>\n\\"), (1, 2, "assistant", r"\### Assistant: </turn> ok"),
    (2, 0, "assistant", None), (2, 1, None, "no role"), (2, 2, "a:b\\###", "####</turn></turn>"), (None, 0, "user", "lost"),
    (3, 0, "user", "tie b"), (3, 0, "user", "tie a"), (3, 0, "user", "tie a"), (4, 0, "user", "long " * 900), (4, 1, "assistant", "é" * 700),
    *[(5, k, ("user", "assistant")[k % 2], f"turn {k} " + "word " * (k * 7 % 50)) for k in range(60)], (5, 60, "system", "late"),
]


@pytest.mark.parametrize("budget,history", [(40, 10), (200, 64), (1024, 256)])
def test_chat_round_trip(spark, budget, history):
    df = spark.createDataFrame(TURNS, "conv_id bigint, turn bigint, role string, text string").withColumn("c", F.lit(1)).repartition(3)
    windows = chat.format_conversations(df, budget, history)
    by = defaultdict(list)
    for conv, turn, role, text in sorted(TURNS, key=lambda t: (repr(t[0]), t[1], t[2] or "", t[3] or "")):
        by[conv].append((role or "", text or ""))
    rows = defaultdict(list)
    for w in windows.collect():
        rows[w.conv_id].append(w)
    encoder = ids()
    for conv, own in rows.items():
        own.sort(key=lambda w: w.window)
        assert [w.window for w in own] == list(range(len(own)))
        new = [t for w in own for t in chat.read_turns(w.text)[w.n_repeated:]]
        assert new == by[conv]
        loss = "".join(chat.unescaped(w.text[a:b]) for w in own for a, b in zip(w.loss_start, w.loss_end))
        assert loss == "".join(t for r, t in by[conv] if r == "assistant")
        at = 0
        for w in own:
            repeated = chat.read_turns(w.text)[:w.n_repeated]
            assert all(t in by[conv][:at] for t in repeated)  # only what came before
            first_system = next((t for t in by[conv][:at] if t[0] == "system"), None)
            assert first_system is None or first_system in repeated
            sizes = sum(len(encoder.encode("".join(chat.turn_parts(*t)))) for t in chat.read_turns(w.text))
            assert w.n_tokens == sizes and (sizes <= budget or w.n_turns == 1)
            at += w.n_turns
    got = {d.conv_id: d for d in chat.digests(windows).collect()}
    for conv, turns in by.items():
        d = got[conv]
        assert d.n_turns == len(turns) and d.formatted_chars == sum(len(w.text) for w in rows[conv])
        assert d.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert chat.format_conversations(df.limit(0)).count() == chat.digests(windows.limit(0)).count() == 0


# pages


def test_pages_match_their_article(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").withColumn("text", F.lit("clash")).withColumn("i", F.lit(1))
    want = {}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html or "", re.S)
        body = re.sub(r"</?(p|h1|br)>", " ", body[1] if body else "")
        want[r.page_id] = " ".join(html.unescape(re.sub(r"<[^>]*>", "", body)).split())
    got = html_content.extract(pages).collect()
    assert len(got) == len(want) and all(g.text == want[g.page_id] and g.n_chars == len(g.text) for g in got)


PAGES = {
    "": "", "plain words only": "plain words only",
    "<p>a<b>b</b> c&amp;d&nbsp; e</p><p>f<br>g</p>": "ab c&d e f g",
    "<nav><a href=x>menu item</a></nav><main><h1>Title</h1><p>Some words here.</p><aside>side</aside><p>More words, &lt;ok&gt;.</p></main><footer>foot</footer>":
        "Title Some words here. More words, <ok>.",
    "<p>one two three</p><div class='comments'><p>reader says things</p></div>": "one two three",
    "<form><p>sign up</p></form><p>text 1 < 2 stays</p><script>var a='</p>';</script><!-- no > -->": "text 1 < 2 stays",
    "<div id=cookieNotice>accept</div><section><p>good text here</p></section>": "good text here",
    "<p>cut off in a tag <a href='x": "cut off in a tag",
    "<script>only code</script>": "",
}


def test_pages_by_hand(spark):
    rows = [(k, "u", h) for k, h in enumerate(PAGES)] + [(None, None, None), (99, "u", "<p>" + "long text " * 50_000 + "</p>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    weights = html_content.fit_weights(spark.read.parquet(f"{FOLDER}/pages.parquet"))
    for w in (weights, {}):
        got = {r.page_id: r.text for r in html_content.extract(df, w).collect()}
        assert [got[k] for k in range(len(PAGES))] == list(PAGES.values())
        assert got[None] == "" and len(got[99]) == 499_999
    assert html_content.extract(df.limit(0)).count() == 0


PROSE = " ".join(f"prose{k}" for k in range(80))
NAMED_PAGES = {
    f"<body class='has-sidebar'><p>{PROSE}</p><div class=sidebar>side text</div></body>": PROSE,
    f"<article class='post category-legal'><p>{PROSE}</p></article>": PROSE,
    f"<main id=search-results><p>{PROSE}</p></main>": PROSE,
    f"<div class='layout with-sidebar'><article><p>{PROSE}</p><div class='related'>see also this</div></article></div>": PROSE,
    f"<h1>Title</h1><div class='content with-sidebar'><p>{PROSE}</p></div>": f"Title {PROSE}",
    f"<div class='page no-comments'><div class='content with-sidebar'><p>{PROSE}</p></div></div>": PROSE,
    f"<p class='form-intro'>{PROSE}</p><p class=ad>buy this now</p>": PROSE,
    f"<article><p>{PROSE}</p></article><div class=comments><article class=comment><p>{'says ' * 60}</p></article></div>": PROSE,
    f"<div class='ad'>{'buy ' * 30}</div><p>{PROSE}</p>": PROSE,
    "<div class='ad'>buy now</div>": "",
}


def test_names_do_not_put_the_article_outside(spark):
    weights = html_content.fit_weights(spark.read.parquet(f"{FOLDER}/pages.parquet"))
    for w in (weights, {}):
        assert [html_content.main_text(p, w)[0] for p in NAMED_PAGES] == list(NAMED_PAGES.values())


MENU = "<a href=x>menu entry</a> " * 30
BROKEN_PAGES = {
    f"<body><form id=aspnetForm><div><h1>Title</h1><p>{PROSE}</p><select><option>one</select></div></form></body>": f"Title {PROSE}",
    f"<body><form><fieldset><p>{PROSE}</p></fieldset></form></body>": PROSE,
    f"<body><form><nav>{MENU}</nav><main><p>{PROSE}</p></main></form></body>": PROSE,
    f"<body><header><p>Site name</p>{MENU}<main><p>{PROSE}</p></main></body>": PROSE,
    f"<body><header>{MENU}<article><header><h1>x</h1></header><p>{PROSE}</p></article></body>": PROSE,
    f"<body><nav><ul><li>{MENU}</ul><section><p>{PROSE}</p></section></body>": PROSE,
    f"<body><nav>{MENU}<article><p>{PROSE}</p></article><footer>foot</footer></body>": PROSE,
    f"<body><div aria-hidden=true><main><p>{PROSE}</p></main></div><div role=dialog>{'accept this ' * 40}</div></body>": PROSE,
    f"<body><main aria-hidden=true><p>{PROSE}</p></main></body>": PROSE,
    f"<body><div hidden><article><p>{PROSE}</p></article></div><p>seen words here</p></body>": "seen words here",
    f"<body><nav>{MENU * 20}</nav><p>{PROSE}</p><form><p>sign up for our letter today</p></form></body>": PROSE,
    f"<body><header><section>{'our slogan ' * 9}</section></header><p>{PROSE}</p></body>": PROSE,
}


def test_forms_missing_ends_and_hidden_pages(spark):
    weights = html_content.fit_weights(spark.read.parquet(f"{FOLDER}/pages.parquet"))
    for w in (weights, {}):
        for page, want in BROKEN_PAGES.items():
            assert html_content.main_text(page, w)[0] == want


def test_bad_markup_takes_linear_time():
    began = time.process_time()
    for page in ("<div>" * 100_000 + "</td>" * 100_000, "<header><main>" * 50_000, "<nav><section>" * 50_000, "<" * 100_000):
        html_content.main_text(page, {})
    assert time.process_time() - began < 8


def test_best_stretch_is_a_linear_scan():
    """The score equals the best of all stretches."""
    rng = random.Random(3)
    for _ in range(40):
        page = "".join(rng.choice(["<p>a b c</p>", "<li><a>x</a></li>", "<td>q</td>", "<h2>t</h2>", "<i>w</i>"]) for _ in range(12))
        weights = {"w:p": 1.5, "w:li+a": -1.0, "w:td": -0.2, "w:h2": 0.4, "t:p": -0.1, "t:li": -1.0, "t:a": -0.5, "t:td": -2.0, "t:h2": -0.1, "t:i": -0.3}
        steps = [n * weights.get(k, 0.5) if k[0] == "w" else weights.get(k, -0.3) for k, _, n, _, _ in html_content.page_tokens(page)]
        best = max(sum(steps[a:b]) for a in range(len(steps)) for b in range(a, len(steps) + 1))
        assert html_content.main_text(page, weights)[1] == pytest.approx(best)


# neighbours


def exact(rows, queries, k=5):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in ok:
        if q in queries:
            score = [(-float((w * v).sum() / math.sqrt((w * w).sum() * (v * v).sum())), i) for i, w in ok if i != q and len(w) == len(v)]
            out[q] = [i for _, i in sorted((round(s, 12), i) for s, i in score)[:k]]
    return out


def test_neighbours_recall_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.standard_normal(16).astype("f4")]) for k in range(1_500)]
    rows += [(k, [1.0, 2.0] + [0.0] * 14) for k in range(1_500, 2_000)]  # one very common vector
    rows += [(5_000, None), (5_050, []), (5_100, [0.0] * 16), (5_150, [float("nan")] + [1.0] * 15), (5_200, [None] + [1.0] * 15), (None, [1.0] * 16),
             (5_250, [float("inf")] + [1.0] * 15), (5_300, [3.0, 4.0]), (5_350, [6.0, 8.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("v", F.lit(1)).withColumn("shard", F.lit(1)).repartition(3)
    got = defaultdict(list)
    for r in sorted(lsh_forest.search(df, df.where("vec_id % 50 = 0"), shard_rows=700).collect(), key=lambda r: r.rank):
        assert r.rank == len(got[r.query_id]) + 1
        got[r.query_id].append(r.vec_id)
    want = exact(rows, {i for i, _ in rows if i is not None and i % 50 == 0})
    assert set(got) == set(want)
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    assert got[5_300] == [5_350] and got[1_500] == [1_501, 1_502, 1_503, 1_504, 1_505] and got[1_950] == [1_500, 1_501, 1_502, 1_503, 1_504]
    assert lsh_forest.search(df.limit(0), df.limit(0)).count() == 0


def test_neighbours_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = exact(rows, {i for i, _ in rows if i is not None and i % 50 == 0})
    got = defaultdict(set)
    for r in lsh_forest.search(df, df.where("vec_id % 50 = 0"), shard_rows=1_000).collect():
        got[r.query_id].add(r.vec_id)
    assert sum(len(got[q] & set(v)) for q, v in want.items()) >= 0.9 * sum(map(len, want.values()))


# toxicity


def osa(a, b):
    """Edit distances (swaps of neighbours count once) of a to every beginning of b."""
    d = [[i + j for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1]


def test_automaton_equals_edit_distance():
    terms = [("scum", False), ("idiot", False), ("worthless", False), ("lowei", True), ("abab", False), ("aabbaabb", True)]
    model, rng = toxicity.Model(terms), random.Random(4)
    for _ in range(4_000):
        w = list(rng.choice(terms)[0]) + rng.choice([[], [], list("abx")])
        for _ in range(rng.randint(0, 3)):
            k, op, c = rng.randrange(len(w) + 1), rng.randrange(4), rng.choice("abcdeilmost")
            if op == 0:
                w.insert(k, c)
            elif op == 1 and 0 < k < len(w):
                del w[k]
            elif op == 2 and k < len(w):
                w[k] = c
            elif op == 3 and k + 1 < len(w):
                w[k], w[k + 1] = w[k + 1], w[k]
        word = "".join(w)
        near = [(min(osa(t, word)) if stem else osa(t, word)[-1], -len(t), t) for t, stem in terms]
        best = min((x for x in near if x[0] <= toxicity.edits_allowed(-x[1])), default=None)
        assert model.nearest(word) == (best and (best[2], best[0]))


def test_toxicity_learns_and_holds_out(spark):
    rng = np.random.default_rng(8)
    calm = [f"word{k}" for k in range(800)]
    rows, labels = [], []
    for k in range(900):
        text = list(rng.choice(calm, 40))
        if k % 9 == 0:
            text[7] = ("blockhead", "nitwit", "dunce,")[k // 9 % 3]
        rows.append((k, " ".join(text), "en", "a"))
        labels.append((k, int(k % 9 == 0)))
    docs = documents(spark, rows)
    learned = docs.drop("label").join(spark.createDataFrame(labels, "doc_id bigint, label int").where(~toxicity.held_out(F.col("doc_id"))), "doc_id")
    model = toxicity.fit(learned)
    assert {t for t, _ in model.terms} == {"blockhead", "nitwit", "dunce"}
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all((got[k].predicted == 1) == bool(y) for k, y in labels if got[k].held_out)
    odd = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "you blokchead", "en", "a"), (4, 'they said "blockhead" to me', "en", "a"), (None, "nitwit!", "en", "a"),
           (5, "nitwit " * 30_000, "en", "a"), (5, "a nitwjt", "en", "a")]
    got = Counter((r.doc_id, r.predicted) for r in toxicity.score(documents(spark, odd), model).collect())
    assert got == Counter([(1, 0), (2, 0), (3, 1), (4, 0), (None, 1), (5, 1), (5, 1)])
    assert toxicity.score(documents(spark, []), model).count() == 0
    assert toxicity.fit(learned.limit(0)).terms == []


def test_two_edits_from_eight_letters_on():
    model = toxicity.Model([("nuisance", False), ("blockhead", False), ("scoundre", True), ("rascals", False)])
    for word, term in (("unisanec", "nuisance"), ("nuissanxe", "nuisance"), ("blokchaed", "blockhead"), ("scuondrxls", "scoundre")):
        assert model.nearest(word) == (term, 2)
    assert model.nearest("rsacasl") is None and model.nearest("rsacals") == ("rascals", 1)


def test_quotation_marks_are_weighed_by_the_labels(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(900):
        text = list(rng.choice([f"word{k}" for k in range(800)], 40))
        if k % 9 == 0:
            text[7] = ("blockhead", "nitwit", "dunce")[k // 9 % 3]
            if k % 2:
                text[7] = f'"{text[7]}"'  # direct speech, and abuse all the same
        rows.append((k, " ".join(text), int(k % 9 == 0)))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id bigint, text string, label int"))
    assert model.context["<quoted>"] > -0.5 and model.context["<mention>"] == toxicity.MENTION_PRIOR


# language model


def slow_kneser_ney(train, gram):
    """Probability of a gram's last symbol, written as in the papers."""
    n = kneser_ney.ORDER
    counts = {n: Counter(g for t in train for g in windows(t))}
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def p(g):
        if not g:
            return 1 / kneser_ney.UNITS
        own = counts[len(g)]
        d = (0.0, *kneser_ney.discounts(*[sum(1 for c in own.values() if c == k) for k in (1, 2, 3, 4)]))
        same = {h: c for h, c in own.items() if h[:-1] == g[:-1]}
        if not same:
            return p(g[1:])
        total, c = sum(same.values()), own.get(g, 0)
        back = sum(d[min(x, 3)] for x in same.values())
        return ((c - d[min(c, 3)]) + back * p(g[1:])) / total

    return p(gram)


def windows(text):
    line = "\x02" * 3 + " ".join(text.lower().split())
    return [line[k:k + 4] for k in range(len(line) - 3)] if text.strip() else []


@pytest.mark.parametrize("shard_grams", [40, kneser_ney.SHARD_GRAMS])
def test_language_model_against_the_formula(spark, shard_grams):
    train = ["the cat sat on the mat", "the dog ate the cat", "a cat and a dog", "Mats  and\ncats é"]
    odd = ["the mat", "zzz qqq", "", None, "É é 日本", "the cat " * 2_000]
    rows = [(k, t, "en", "a") for k, t in enumerate(train)] + [(10 + k, t, None, "a") for k, t in enumerate(odd)] + [(None, "the cat", "de", "a"), (0, train[0], "en", "a")]
    trusted = spark.createDataFrame([(0,), (1,), (2,), (3,), (3,), (None,)], "doc_id bigint")
    got = kneser_ney.quality(documents(spark, rows), trusted, shard_grams=shard_grams).collect()
    assert len(got) == len(rows)
    learned = train + [train[0]]  # the repeated row is a document as well
    for r, (i, t, _, _) in zip(sorted(got, key=lambda r: (repr(r.doc_id), r.n_grams)), sorted(rows, key=lambda r: (repr(r[0]), len(windows(r[1] or ""))))):
        grams = windows(t or "")
        assert (r.doc_id, r.n_grams) == (i, len(grams))
        if 0 < len(grams) < 100:
            assert r.log_ppl == pytest.approx(-sum(math.log(slow_kneser_ney(learned, g)) for g in grams) / len(grams), rel=1e-9)
        assert r.kept or not grams or r.log_ppl > r.limit
    assert {r.doc_id for r in got if not r.n_grams} == {12, 13} and not any(r.kept for r in got if not r.n_grams)
    nothing = kneser_ney.quality(documents(spark, rows), trusted.limit(0)).collect()
    assert all(r.kept == (r.n_grams > 0) and r.limit is None for r in nothing)
    assert kneser_ney.quality(documents(spark, []), trusted).count() == 0


def test_language_model_on_labels(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "quality")
    got = kneser_ney.quality(docs, labels.where("quality = 1 and doc_id % 3 <> 1").select("doc_id")).join(labels, "doc_id").where("doc_id % 3 = 1").collect()
    good = [r for r in got if r.quality == 1]
    assert sum(r.kept for r in good) >= 0.97 * len(good)
    bad = [r for r in got if r.quality == 0]
    assert sum(not r.kept for r in bad) >= 0.5 * len(bad)
