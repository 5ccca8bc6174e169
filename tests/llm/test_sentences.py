import pytest

from codequarry.llm import sentences as sn

#: A small corpus in which abbreviations stand within sentences and ordinary words at block ends.
STEMS = [
    "The cache is full.", "We moved the file.", "Is it done?", "It failed again!", "Dr. Ost asked for it.", "See Fig. 4 of the notes.", "Use it, e.g. the first one, now.",
    "Run it at 7 p.m. on the host.", "Das ist z. B. gut.", "Siehe Nr. 7 im Buch.", "Am 5. Mai lief der Test.", "Он ответил так.", "Это т. е. граф.", "她说：“节点正常！”", "日志写着“不见了。要重试吗？”之后没有了。",
    "模块保存了数据。", 'She said: "Drop it."', 'The log said "It is gone. Retry?" and ended.', "(See the rest.)", "Well... it works.", "यह कैश है।", "ระบบเก็บไว้แล้ว", "เรียบร้อยแล้วค่ะ",
]


def corpus():
    texts = []
    for k in range(600):
        own = [STEMS[(k * 7 + j * 5) % len(STEMS)] for j in range(1 + k % 5)]
        thai = [s for s in own if "฀" <= s[0] <= "๿"]
        rest = [s for s in own if s not in thai]
        texts.append("\n\n".join(filter(None, [" ".join(rest), " ".join(thai)])))
    return texts


@pytest.fixture(scope="module")
def model(spark):
    return sn.train(spark.createDataFrame([(i, t) for i, t in enumerate(corpus())], "doc_id long, text string"))


def cut(text, model):
    out, at = [], 0
    for e in sn.sentence_ends(text, model):
        out.append(text[at:e].strip())
        at = e
    return out


def test_held_out_accuracy(model):
    right = total = 0
    for k in range(200):
        own = [STEMS[(k * 11 + j * 3 + 1) % len(STEMS)] for j in range(4)]
        own = [s for s in own if not "฀" <= s[0] <= "๿"]
        want = set()
        text = ""
        for s in own:
            text = f"{text} {s}".strip()
            want.add(len(text))
        got = set(sn.sentence_ends(text, model))
        right += 2 * len(want & got)
        total += len(want) + len(got)
    assert right / total > 0.97


def test_structure(model):
    text = "# Title v1.2\nFirst line\ngoes on. Second\n\n- item one. More\n2. other\n\n```js\na. b();\n\nc\n```\nlast without mark"
    assert cut(text, model) == ["# Title v1.2", "First line\ngoes on.", "Second", "- item one.", "More", "2. other", "```js\na. b();\n\nc\n```", "last without mark"]
    assert cut("Im\n2. Lauf war es.", model)[0].startswith("Im")
    assert cut("ระบบเก็บไว้แล้ว เรียบร้อยแล้วค่ะ", model) == ["ระบบเก็บไว้แล้ว", "เรียบร้อยแล้วค่ะ"]
    assert cut("ฟังก์ชัน run คืนค่า", model) == ["ฟังก์ชัน run คืนค่า"]
    assert cut("Well... it works. Node.js 4.5 is out!  What?! Yes.", model) == ["Well... it works.", "Node.js 4.5 is out!", "What?!", "Yes."]
    assert cut("﻿The cache is full.\r\n\r\nIt failed again!", model)[0] == "﻿The cache is full."


def test_rows(spark, model):
    rows = [(1, "It failed again! Is it done?", 0), (1, "It failed again! Is it done?", 0), (2, None, 0), (3, "", 0), (4, " \n\t﻿ ", 0), (5, "The cache is full. " * 5000, 0)]
    got = sn.split_sentences(spark.createDataFrame(rows, "doc_id long, text string, sent_end int"), model=model)
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append((r.sent_no, r.sent_start, r.sent_end))
    assert sorted(by[1]) == [(0, 0, 16), (1, 17, 28)] and set(by) == {1, 5} and len(by[5]) == 5000


def test_letters_may_overrule_a_blank():
    """A blank between Thai letters is an end by its prior alone, and none where the letters on both sides speak against it."""
    here, there = "กขค งจฉ", "ชซฌ ญฎฏ"
    against = {f"<{'กขค'[-n:]}": -2.0 for n in (1, 2, 3)} | {f">{'งจฉ'[:n]}": -2.0 for n in (1, 2, 3)}
    assert sn.BLANK < sn.CLIP and sn.sentence_ends(here, sn.Model()) == [3, 7]
    assert sn.sentence_ends(here, sn.Model(letters=against)) == [7] and sn.sentence_ends(there, sn.Model(letters=against)) == [3, 7]


def test_letters_are_learnt(spark):
    """Where a word is written with a blank inside it now and then, its letters outweigh the blank; elsewhere they confirm it."""
    texts = ["กขคงจฉชซ ญฎฏฐฑฒ" for _ in range(300)] + ["ญฎฏฐฑฒ กขคงจฉชซ" for _ in range(300)] + ["กขค งจฉชซ"]
    model = sn.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sn.sentence_ends("กขคงจฉชซ ญฎฏฐฑฒ", model) == [8, 15] and sn.sentence_ends("กขค งจฉชซ", model) == [9]


@pytest.mark.parametrize("text", ["ខ្ញុំទៅផ្ទះ។ គាត់មក។", "ကျွန်တော်သွားတယ်။ သူလာတယ်။", "ሰላም ነው። ደህና ነኝ።", "Սա տուն է։ Նա եկավ։", "བོད་ཡིག།  ཡིན་ནོ།", "ລາວມາແລ້ວ ຂ້ອຍໄປ"])
def test_further_scripts(model, text):
    assert len(sn.sentence_ends(text, model)) == 2


def test_cost_is_linear(model):
    """Long paragraphs of any kind take time in proportion to their length."""
    import time

    for unit in ("The cache (see it) is full. ", "ระบบเก็บไว้แล้ว ", "(((a “b. ", "说：“节点正常！”。", "Fig. 4 "):
        took = []
        for n in (125_000, 500_000):
            text = unit * (n // len(unit))
            began = time.process_time()
            sn.sentence_ends(text, model)
            seen = sn.Counter()
            sn._count_letters(text, seen)
            took.append(time.process_time() - began)
        assert took[1] < 8 * took[0] + 0.5, unit


def test_joined_kinds(spark, model, monkeypatch):
    """Kinds beyond what tasks hold as a list are joined, with the same result."""
    docs = spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string")
    want = sorted(map(tuple, sn.split_sentences(docs).collect()))
    monkeypatch.setattr(sn, "KNOWN_KINDS", 0)
    assert sorted(map(tuple, sn.split_sentences(docs).collect())) == want


def test_empty(spark):
    assert sn.split_sentences(spark.createDataFrame([], "doc_id long, text string")).count() == 0
