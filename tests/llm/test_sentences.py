from __future__ import annotations

import random

import pyarrow.parquet as pq
import pytest

from terravane.llm.prose import masked
from terravane.llm.sentences import sample_texts, sentence_ends, split_sentences, train
from terravane.llm.tagger import Model, _joined, decoded, events, examples, groups, learn, read, sway, viterbi

UNTRAINED = Model()


def _texts(sf):
    return pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["text"])["text"].to_pylist()


@pytest.fixture(scope="module")
def model():
    return learn(_texts("sf0.01"))


#: Sentences are set apart by "|", which is not part of the text.
CASES = [
    "As argued by Braeckler et al. \\cite{b2018}, it holds.| See Sec. 4.1, i.e. the closure.",
    "Dr. Jorenza and Prof. Hepein met J. K. Doraster (unpublished).| It rose from 3.1 to 4.2 m.s$^{-1}$ within 9 h.| We agree.",
    "See Hepwick, Pavwick, etc.| Our drift differs from that of Visorpa et al.| Neither holds at approx. 38.3 K.| Why does it not hold?| Because it drifts!",
    "The referee wrote: ``The yield cannot exceed 22.644.''| The balance reads\n\\[ x = 4. \\]\nwith $p = 2. 1$ as in Ref. [3].",
    "``Why does it drift?'' asked Felithov in 12.| (It was 3.)| We go on (see Eq. (3). Then more) here.",
    "``It rose.| It fell.''",
    "He % note. Really?\ngoes on\\footnote{cf. the manual, v. 2.1}.| Next \\emph{one.}| Last",
    "Version 4.1.7 of the U.S. code ran.| \\emph{Is it so?}| Yes.",
    "Am 14. März wurde bei 6,32 K gemessen.| Die Probe Nr. 8 enthält ca. 3,8 mg, vgl. Gl. (1).| Im 27. Versuch z. B. Wasser, d. h. ohne Luft!",
    "Sarmund u. a. schreiben: „Die Streuung bleibt.“| „Ist das stabil?“ fragte er.| Siehe Kap. 9, Abschn. 1.10.| Dabei gilt T\\\"{u}r.| Ende.",
    "La fig. 1 montre ça, cf. l'éq. (6).| « Où est-ce ? » demandait M. Ulm.| D'après M. Wim, « elle reste ».| Voir Ost et al., chap. 9.| Fin ?",
    "¿Depende la señal de $x$?| ¡La alcanzó núm. 5!| («Es así», dijo ella en 9.)| La Sra. Ulm fue, p. ej. con él.",
    "Это верно, т. к. она мала!| На рис. 2 показано, т. е. так.| А. В. Кушмаров и др. получили это при 12 К.| «Как?» — спрашивал он.",
    "“曲率为什么下降？”这是老问题。|表1列出了（见式(18)。下同）与压力。|文献[8]指出：“约为11.722。”|当$x = 1.4$时，是否稳定？",
    "「残差は一定である。」と先行研究は述べている。|格子（第1.9節を参照。）の粘度。|なぜか。",
    "डॉ. वरेन ने कहा।| “वह स्थिर है।”| क्या मान 5.2 है?",
    "ذكر د. ماهور أن القيمة 3.5 صغيرة.| هل تعتمد القيمة على ذلك؟| نعم إنها تعتمد على ذلك!",
    "Πόσο μεγάλη είναι η τιμή;| Ο κ. Παυλ μέτρησε π.χ. 8,21 K.| Το δηλώνει κ.λπ. του πλέγματος!",
    "รูปที่ 8 แสดงความถี่| ค่าเฉลี่ยคือ 2.553 หน่วย| งานวิจัยนี้วัดผล",
    "No end\n\n|Next paragraph goes on\n",
]


def _cut(case):
    parts = case.split("|")
    text, ends, at = "".join(parts), [], 0
    for part in parts:
        at += len(part)
        ends.append(len(text[:at].rstrip()))
    return text, ends


@pytest.mark.parametrize("case", CASES)
def test_sentences(case, model):
    text, ends = _cut(case)
    found = sentence_ends(text, model)
    assert found == ends, [text[a:b] for a, b in zip([0, *found], found)]


def test_untrained_is_clearly_worse(model):
    """Without weights only ends of paragraphs are found; what is learned makes the difference, also on texts not trained on."""
    inner = right = 0
    for case in CASES:
        text, ends = _cut(case)
        inner += len(ends)
        right += len(set(sentence_ends(text, UNTRAINED)) & set(ends))
    assert right < 0.5 * inner
    seen = set(_texts("sf0.01"))
    fresh = [t for t in _texts("sf0.1")[:1500] if t not in seen]
    chains, known, _ = examples(fresh)
    pairs = [(c, k) for c, k in zip(chains, known) if k >= 0]
    assert len(pairs) > 3000
    rate = lambda m: sum(m.tags(c)[k] for c, k in pairs) / len(pairs)
    assert rate(model) > 0.99 and rate(UNTRAINED) < 0.1


def test_initials_and_abbreviations_are_learned(model):
    """Made-up abbreviations, in no list anywhere, are learned from how they stand in the sample."""
    rng = random.Random(1)
    nouns = ["lattice", "kernel", "membrane", "estimator", "reactor", "sensor"]
    made = lambda: f"The {rng.choice(nouns)} was measured by qrz. Smith in blv. {rng.randint(1, 99)} of the {rng.choice(nouns)}."
    plain = lambda: f"We saw that the {rng.choice(nouns)} drifts."
    docs = ["\n\n".join(" ".join(rng.choice([made, plain])() for _ in range(4)) for _ in range(4)) for _ in range(300)]
    text, ends = _cut("The kernel was measured by qrz. Smith in blv. 7 of the sensor.| We saw that the lattice drifts.| The reactor was measured by qrz. Smith in blv. 70 of the kernel.")
    assert sentence_ends(text, learn(docs)) == ends


def test_prose_only(model):
    text = (
        "\\documentclass{article}\n\\title{A. B. C}\n\\begin{document}\n\\maketitle\n\\begin{abstract}\nOne.\n\\end{abstract}\n\\section{Why? Now. Then}\\label{sec:x}\n"
        "\\input{a/b}\n\n% Draft. Gone.\n\\iffalse\nOld. Text.\n\\fi\nTwo. Three\n\\begin{itemize}\n\\item Four\n\\item Five!\n\\end{itemize}\n\\begin{figure}\n\\caption{No. Prose.}\n\\end{figure}\n"
        "\\begin{tabular}{l}\na. & 1. \\\\\n\\end{tabular}\n\n\\begin{theorem}\nSix. \\end{theorem}\n\\begin{thebibliography}{9}\n\\bibitem{x} A. Name, J. Res. 4.\n"
    )
    found = sentence_ends(text, model)
    assert [text[:e].split("\n")[-1].strip().split()[-1] for e in found] == ["One.", "Two.", "Three", "Four", "Five!", "Six."]


def test_braces_nest_to_any_depth(model):
    deep = "{" * 40 + "Not. Prose." + "}" * 40
    text = f"\\section{{{deep} A. Title}}\nThe kernel was measured\\footnote{{a note. {deep}}} with the sensor. We saw it.\n\n\\newcommand{{\\x}}{{{deep}}}\nThe end"
    assert [text[:e].split()[-1] for e in sentence_ends(text, model)] == ["sensor.", "it.", "end"]
    assert masked("A \\footnote{never closed")[0].startswith("A ")


def test_table(spark, model):
    rows = [(1, "One is so. We saw it."), (2, None), (3, ""), (4, "% only a stub\n"), (None, "Three"), (1, "One is so. We saw it."), (5, "It is so. " * 20_000)]
    docs = spark.createDataFrame(rows, "id long, text string").withColumnRenamed("id", "sent_no")
    out = split_sentences(docs, "sent_no", "text", model).collect()
    count = lambda d: sum(r["doc_id"] == d for r in out)
    assert (count(1), count(2), count(3), count(4), count(None), count(5)) == (4, 0, 0, 0, 1, 20_000)
    assert sorted((r["sent_no"], r["sent_end"]) for r in out if r["doc_id"] == 1) == [(1, 10), (1, 10), (2, 21), (2, 21)]
    assert split_sentences(docs.limit(0), "sent_no", "text").count() == 0
    assert split_sentences(docs.filter("text = 'Three'"), "sent_no", "text").count() == 1


def test_sample_does_not_depend_on_partitions(spark):
    """Of more documents than the sample holds, those with the smallest hashes are taken, whatever the layout and copies."""
    texts = [f"Text {i} of {i % 7}." for i in range(400)]
    one = spark.createDataFrame([(t,) for t in texts] + [("",), (None,)], "text string").coalesce(1)
    order = {r["text"]: r["h"] for r in one.filter("text <> ''").selectExpr("text", "xxhash64(text) h").collect()}
    wanted = sorted(texts, key=order.get)[:40]
    copies = spark.createDataFrame([(wanted[0],)] * 4000 + [("",)] * 4000, "text string")
    for layout in (one, spark.createDataFrame([(t,) for t in texts[::-1]], "text string").repartition(7), one.union(copies)):
        assert sample_texts(layout, "text", 40) == wanted
    assert sorted(sample_texts(one, "text", 1000)) == sorted(texts)
    assert train(one.limit(0), "text").weights == {}


def test_all_texts_are_learned_from(spark):
    """An abbreviation that only texts beyond the 1,500 of the smallest hashes show is learned, in one shard or in several, whatever the layout."""
    rng = random.Random(3)
    nouns = ["lattice", "kernel", "membrane", "estimator", "reactor", "sensor"]
    made = lambda: f"The {rng.choice(nouns)} was measured by qrz. Smith in blv. {rng.randint(1, 99)} of the {rng.choice(nouns)}."
    plain = lambda: f"We saw that the {rng.choice(nouns)} drifts in {rng.randint(1, 99)} of them."
    text = lambda kinds: "\n\n".join(" ".join(rng.choice(kinds)() for _ in range(4)) for _ in range(3))
    usual, others = [text([plain]) for _ in range(1600)], [text([made, plain]) for _ in range(4000)]
    hashes = {r["t"]: r["h"] for r in spark.createDataFrame([(t,) for t in usual + others], "t string").selectExpr("t", "xxhash64(t) h").collect()}
    bound = sorted(hashes[t] for t in set(usual))[1500]
    texts = usual + [t for t in others if hashes[t] > bound]
    assert len(texts) > 1700
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    case, ends = _cut("The kernel was measured by qrz. Smith in blv. 7 of the sensor.| We saw that the lattice drifts in 5 of them.| It is so.")
    for shard_chars in (10**9, 200_000):
        model = train(docs, "text", shard_chars)
        assert sentence_ends(case, model) == ends
    copies = spark.createDataFrame([(t,) for t in texts[::-1] + texts[:90] + [None, ""] * 9], "text string").repartition(7)
    assert train(copies, "text", 200_000).weights == model.weights


def test_texts_are_read_once(spark):
    """Documents are read once, to learn and to tag; copies of a text give their sentences each, whatever their ids."""
    texts = ["The kernel drifts. We saw it.\n\nIt is so. We agree.\n\nThe end."] * 10_003 + ["One is so."]
    ids = [None, 2**60 + 1, *range(10_001), 2**60 + 3]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    docs = spark.createDataFrame([(None if i is None else str(i), t) for i, t in zip(ids, texts)], "id string, text string").mapInPandas(counted, "id string, text string")
    out = split_sentences(docs, "id", "text").collect()
    assert seen.value == len(texts)
    per = {}
    for r in out:
        per.setdefault(r["doc_id"], []).append((r["sent_no"], r["sent_end"]))
    assert set(per) == set(ids) and len({tuple(sorted(v)) for d, v in per.items() if d != 2**60 + 3}) == 1 and per[2**60 + 3] == [(1, 10)]


def test_short_ways_give_the_same():
    """Tags found from sure scores are those of Viterbi, chains patched at their ends are those of the joined paragraphs."""
    rng = random.Random(5)
    turns = {g: tuple(rng.gauss(0, 1) for _ in range(4)) for g in "01234"}
    for _ in range(3000):
        chain, scores, at, inside = [], [], 0, False
        for _ in range(rng.randint(1, 9)):
            at += rng.choice([1, 2, 5, 9, 40])
            kind = rng.choice(["cand", "cand", "shut" if inside else "open"])
            inside = kind == "open" or inside and kind != "shut"
            chain.append((kind, at, None))
            scores.append(0.0 if kind == "open" else rng.choice([rng.gauss(0, 2), rng.gauss(0, 12), float("-inf")]))
        assert decoded(chain, scores, turns, sway(turns), groups(chain)) == viterbi(chain, scores, turns)
    cases = [c.replace("|", "\n\n" if i % 2 else "") for i, c in enumerate(CASES)] + ["A (b.\n\n» C. D [e.\n\nF.) g \\cite{x}\n\n(H; i.\n\nΤι; Ναι.\n\n“下。”\n\n“下。", "他说。下\n\n下。\n\n！是。"]
    for text in [*cases, "\n\n".join(cases), *_texts("sf0.001")]:
        _, chains, parts = read(text)
        for (chain, known), first, second in zip(chains, parts, parts[1:]):
            both, joint = _joined(first, second)
            wanted = [e for e in events(both, len(both), joint)[0] if e[1] <= joint]
            assert chain == wanted
            assert known == max((k for k, e in enumerate(wanted) if e[0] != "open" and e[1] == joint and e[2]), default=-1)


THAI = "ค่าเฉลี่ยคือ 2.5 หน่วย งานวิจัยนี้วัดผล รูปที่ 8 แสดง"
#: Words of Lao, a script that this project's data do not hold.
LAO = ["ການວິໄຈ", "ວັດແທກ", "ຄວາມຖີ່", "ຜົນໄດ້ຮັບ", "ສອດຄ່ອງ", "ກັບ", "ແບບຈຳລອງ"]


def test_unmarked_scripts_are_learned(model):
    cuts = [THAI.index(" งาน"), THAI.index(" รูป"), len(THAI)]
    assert sentence_ends(THAI, model) == cuts
    assert sentence_ends(THAI, UNTRAINED) == [len(THAI)]
    rng = random.Random(2)
    sentence = lambda: "".join(rng.sample(LAO, 4)) + f" {rng.randint(1, 99)} " + "".join(rng.sample(LAO, 3))
    docs = ["\n\n".join(" ".join(sentence() for _ in range(3)) + rng.choice(["", "."]) for _ in range(4)) for _ in range(150)]
    parts = [sentence() for _ in range(4)]
    text, ends = _cut("| ".join(parts))
    assert sentence_ends(text, learn(docs)) == ends
