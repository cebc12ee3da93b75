from __future__ import annotations

import random
import time

import numpy as np

from terravane.llm.leaks import Anchors, leaked_items, without_leaks, without_spans
from terravane.llm.markup import letters_only, readable, traced_letters

ITEM = "The judge of a village with 232 masons records 762 tiles on a trough, and every 9 weeks the hatch swallows 17.699 of them."
OTHER = "Une énergie de 9,37 joules glisse sur dix mètres le long d'un quai, puis heurte un piège givré devant la grève du village."
ZH = "一只质量为十七克的铜环从倾斜八百度的玻璃板上滑下三十九米后撞上铁钩旁边八百名工人轮流记下时刻若木桌完全干燥求沙袋通过前九厘米所需的秒数并由三百次试验估计弹簧的误差是否小于二十秒"


def leaks(spark, texts, items, **more):
    docs = spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string").withColumnRenamed("doc_id", "item_id")
    table = spark.createDataFrame(items, "item_id long, text string")
    return {(r["item_id"], r["doc_id"]): r["shared"] for r in leaked_items(docs, "item_id", "text", table, "item_id", "text", **more).collect()}


def plain(text):
    return letters_only(readable(text)).tobytes().decode("utf-32-le")


def brute(texts, items, run=60):
    out = set()
    for d, t in enumerate(texts, 100):
        for i, item in items:
            a, b = plain(t or ""), plain(item or "")
            if any(b[k : k + run] in a for k in range(len(b) - run + 1)):
                out.add((i, d))
    return out


def test_forms(spark):
    half = ITEM[:80]
    texts = [
        "Before. " + ITEM + " After.",
        ITEM.upper(),
        "% " + ITEM.replace(" and ", " and\n% "),
        ITEM.replace("masons", r"\emph{masons}").replace("tiles", r"{\it tiles}").replace("hatch", r"hat\-ch").replace("weeks", r"weeks~\cite{abc2001}").replace("762", "$762$"),
        "\\newcommand{\\aax}{masons}\n\\def\\shq{tiles}\n" + ITEM.replace("masons", r"\aax{}").replace("tiles", r"\shq{}"),
        OTHER.replace("é", r"\'e").replace("è", r"\`{e}"),
        half,
        ITEM[:50],
        "ＴＨＥ ｊｕｄｇｅ" + ITEM[9:],
        ZH,
        ITEM + "\n" + OTHER,
        "",
        None,
        "x" * 300_000 + ITEM,
    ]
    items = [(1, ITEM), (2, OTHER), (3, ZH), (4, None), (5, ""), (6, ITEM[:40])]
    found = leaks(spark, texts, items)
    assert set(found) == brute(texts, items)
    assert {(1, 100 + k) for k in (0, 1, 2, 3, 4, 6, 8, 10, 13)} | {(2, 105), (2, 110), (3, 109)} == set(found)
    assert found[1, 100] == len(plain(ITEM)) and found[1, 106] == len(plain(half))
    # The same in blocks, with other n-grams, and for repeated rows.
    assert leaks(spark, texts, items, block_chars=150) == found == leaks(spark, texts, items, gram=17)
    assert leaks(spark, texts, items + items[:1]) == found


def test_nothing(spark):
    assert leaks(spark, [ITEM], []) == {} == leaks(spark, [], [(1, ITEM)])


def test_documents_without_leaks(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "doc_id long, text string")
    found = spark.createDataFrame([(9, 2, 60), (8, 2, 70)], "item_id long, doc_id long, shared int")
    assert sorted(r["text"] for r in without_leaks(docs, "doc_id", found).collect()) == ["a", "c"]


def test_macros_resolve_to_any_depth():
    chain = "".join(f"\\newcommand{{\\{'q' * k}a}}{{\\{'q' * (k + 1)}a}}" for k in range(1, 60)) + f"\\def\\{'q' * 60}a{{the words}}"
    assert plain(chain + " Say \\qa{} now") == "saythewordsnow"
    assert plain("\\newcommand{\\x}{" + "{" * 30 + "deep" + "}" * 30 + "} Say \\x.") == "saydeep"
    assert plain("\\def\\x{one \\y}\\def\\y{two \\x} Say \\x") == "sayonetwo"
    assert plain("\\newcommand{\\v}[1]{\\mathbf{#1}} Say \\v{x}") == "sayx"


def test_longest_runs_like_brute_force():
    rng = random.Random(3)
    word = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    for letters in ("ab", "abcdefghij"):
        items = [(k, word(rng.randint(5, 120), letters)) for k in range(12)]
        texts = []
        for _ in range(30):
            parts = [word(rng.randint(0, 40), letters)]
            for _ in range(rng.randint(0, 4)):
                item = rng.choice(items)[1]
                a = rng.randint(0, len(item))
                parts += [item[a : a + rng.randint(0, 60)], word(rng.randint(0, 10), letters)]
            texts.append("".join(parts))
        wanted = {}
        for n, t in enumerate(texts):
            for i, item in items:
                size = max((b for a in range(len(item)) for b in range(len(item) - a + 1) if item[a : a + b] in t), default=0)
                if size >= 18:
                    wanted[n, i] = size
        anchors = Anchors(items, 18, 9)
        assert {(n, i): size for n, i, size in anchors.scan([letters_only(t) for t in texts])} == wanted


def test_many_equal_hits_are_quick():
    """Equal characters without end, and a sentence that thousands of items share."""
    began = time.perf_counter()
    assert Anchors([(1, "a" * 600)], 60, 30).scan([np.full(20_000, 97, np.uint32)]) == [(0, 1, 600)]
    shared = "thisisasentencethatmanyitemssharewordforwordandthatislongenoughtocount"
    many = Anchors([(i, f"{i}xx{shared}yy{i}zz") for i in range(4000)], 60, 30)
    assert len(many.scan([letters_only(shared * 40)])) == 4000
    assert time.perf_counter() - began < 10


def test_spans_are_cut(spark):
    half = ITEM[:80].rstrip(" ,")
    texts = ["Before. " + ITEM + " After.", "Keep (" + OTHER.replace("é", r"\'e") + ") this", "\\def\\shq{tiles}A. " + ITEM.replace("tiles", r"\shq{}") + " Z.", half + " QQ " + half + " end", "", None, "Nothing"]
    docs = spark.createDataFrame([(t, k) for k, t in enumerate(texts)], "item_id string, n int")
    items = spark.createDataFrame([(1, ITEM), (2, OTHER)], "item_id long, text string")
    out = [r for r in without_spans(docs, "item_id", items, "item_id", "text").orderBy("n").collect()]
    assert [r["item_id"] for r in out] == ["Before. . After.", "Keep (.) this", "\\def\\shq{tiles}A. . Z.", " QQ  end", "", None, "Nothing"]
    assert [r["_cut_letters"] for r in out] == [len(plain(ITEM)), len(plain(OTHER)), len(plain(ITEM)), 2 * len(plain(half)), 0, 0, 0]
    again = without_spans(docs, "item_id", items, "item_id", "text", block_chars=130)
    assert again.columns == ["item_id", "n", "_cut_letters"]
    assert sorted(map(tuple, again.collect()), key=lambda r: r[1]) == [tuple(r) for r in out]


def test_letters_are_traced():
    for t in ("\\'{e}a \\c cb", "e\u0301x ﬁ Å", "\\def\\a{\\b o}\\def\\b{n}x\\a y [3] \\\"uz", "가\u1100\u1161"):
        codes, first, last = traced_letters(t)
        assert codes.tolist() == letters_only(readable(t)).tolist() and (first < last).all() and (last <= len(t)).all()
