import pytest

from plumbline.llm import sentences as S


def cut(text, corpus=None):
    return [text[a:b] for a, b in S.split(text, corpus)]


CASES = [
    ["Dr. Vela met Mr. and Mrs. Oru at 10 a.m. by the mill.", "The gate closed at 5 p.m.", "The lamp was lit."],
    ["It ran v2.0.6 on 16/4/2030; it took 99.27 s vs. 220.27 s before.", "See Fig. 25 and No. 503, cf. Sec. 8.2 of it.", "No.", "The queue moved."],
    ["“Was the card lost?” asked Tukel.", "The sign said, “It is idle.”", "If so, he left."],
    ["The label read “No refunds!” in red ink.", "Was it really “late?”", "Every one was."],
    ["J. M. Noro of Zamo Ltd. in March went home.", "We did it for Keba & Co.", "The next went well."],
    ["(The bill was seen by Mr. Oru twice.)", "[It was mild!]", "They asked why (“keen, isn't it?”) it stood."],
    ["Stop!", "Hm?", "Well... the correction was noted.", "Zeke waited… then left."],
    [
        "Vgl. Abs. 4 der Frist, d. h. die Karte.", "Die 3. Übersicht kam am 2. 8. 2021 an.", "Am 5. Mai kam er.",
        "Prof. Tineto sagte: „Die Karte ist da.“", "Wer kam?", "„Ist sie da?“, fragte Hisi."
    ],
    [
        "« La note est-elle là ? » demanda Hisila.", "M. Gapafe rejeta la décision no 874, p. ex. avant le contrôle.",
        "Selon Mme Palo, elle suffit !", "L'an 2026, J.-P. Sife archiva 85 fiches… sans la clause."
    ],
    [
        "Según el art. 7, la alarma de D. Jalu es húmeda.", "El Dr. Gobo midió la ficha de EE. UU. el fin de semana.", "¿De verdad...?",
        "«¿Está abierta?», preguntó Sade."
    ],
    [
        "Ks. liite 22, jossa raja ym. siirtyi.", "Kokous on 3. päivä klo 17.22 mennessä.", "”Onko sääntö vanha?” kysyi Savi.",
        "Hinta nousi 3,8 %:iin!", "Tri Mole mittasi asiakirjan nro 790."
    ],
    [
        "В 2024 г. Lortu вернул карту, т. е. карту и очередь.", "Это стоило 456 тыс. руб., т. к. Sulbe ушёл.", "Неужели?!",
        "«Где ответ?» — спросил Jarota.", "Zomeno сказал: «Я вернул сводку».", "Цена выросла до 32,43 руб. за очередь."
    ],
    ["د. Pingri رفض الحوالة رقم 387.", "«أين الفاتورة؟» سأل Quopa.", "بلغ السعر 220.87 د.إ. بعد أن نقل Lema النموذج.", "هل قاس Nosi الرف؟"],
    ["रु. 363.79 का बिल Nivavi ने लिखा।", "“यह पुराना है।” Pinja ने कहा।", "“क्या समय है?” Bemar ने पूछा।", "अरे!", "डॉ. Logri ने लिखा।"],
    ["V3.5.8 판에서 조항을 옮겼다!", "“봤습니까?”라고 Maso 씨가 물었다.", "2034. 10. 27. 회의에서 취소했다."],
]


@pytest.mark.parametrize("want", CASES, ids=lambda c: c[0][:20])
def test_spaced(want):
    assert cut(" ".join(want)) == want
    assert cut("\n".join(want)) == want or any(w[0].isdigit() for w in want)


def test_unspaced():
    zh = [
        "“账户扫描了吗？”鹭皓问。", "阙栖皓说：“清单已经分类！”", "翎禾扫描了528份公告。", "“楼梯整齐吗？”“不，已经推迟。”两人说完就走了。", "闹钟（含迟到的货架。）由鹭稷测量。", "“诊所很空闲。”柜台的人说，“请提前更正。”",
        "铎枫写道：“桥梁……算了。”", "据No. 98号秤砣，归档了240.85kg菜单。", "谁拒绝了合同？！"
    ]
    assert cut("".join(zh)) == zh
    ja = ["「黄色い検査ですね。」「はい、黛禾が訂正した。」と二人は話した。", "枫棠さん、付録が……欠けたようです！", "検査（遅いものを除く。）は週末に見落とした。"]
    assert cut("".join(ja)) == ja
    assert cut("第一行\n第二行。第三") == ["第一行", "第二行。", "第三"]
    th = ["เวลา 17.37 น. เจ้าหน้าที่ย้ายบัญชี", "เราควรเก็บรายงานบ่อย ๆ ก่อนยกเลิก", "ค่าใช้จ่ายของ RH-8576 คือ 160.97 บาท"]
    assert cut(" ".join(th)) == th


def test_lines_and_lists():
    text = "Notes on it\r\n\r\n1. One thing. And more.\n2. Two\n\n- a bit\n- of it\n \nA line that\nis wrapped. Done."
    assert cut(text) == ["Notes on it", "1. One thing. And more.", "2. Two", "- a bit", "- of it", "A line that\nis wrapped.", "Done."]


def test_places_and_edges():
    text = "﻿  One here.  Two 🙂 there. \n"
    assert [(a, b, text[a:b]) for a, b in S.split(text)] == [(3, 12, "One here."), (14, 26, "Two 🙂 there.")]
    assert S.split(None) == S.split("") == S.split(" \n﻿\t") == []
    assert cut("no end at all") == ["no end at all"]


def test_evidence_of_the_document():
    assert cut("The qrz. was open. He saw the qrz. Oru then.") == ["The qrz. was open.", "He saw the qrz. Oru then."]


def test_long():
    text = "A word here. " * 50_000
    assert len(S.split(text)) == 50_000


def test_operator(spark, data):
    rows = [(1, "One. Two.", "x"), (2, None, "y"), (3, "  ", "z"), (1, "One. Two.", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    assert sorted(map(tuple, S.sentences(df).collect())) == [(1, 0, 4), (1, 0, 4), (1, 5, 9), (1, 5, 9)]
    assert S.sentences(df.where("false")).count() == 0
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = S.sentences(docs).join(docs, "doc_id").selectExpr("substring(text, start_char + 1, end_char - start_char) as s").collect()
    assert got and all(r.s == r.s.strip() and r.s for r in got)


def test_nesting_has_no_bound():
    """A quotation with many bracketed notes, deep brackets and many unclosed quotes."""
    for notes in (3, 60, 500):
        text = "“" + "He spoke [a short note]. " * notes + "It was so.” And then came the end."
        assert [text[a:b] for a, b in S.split(text)][-1] == "And then came the end." and len(S.split(text)) == 2
    assert len(S.split("(" * 5000 + "One. Two." + ")" * 5000)) == 1
    assert len(S.split("“ " * 500 + "(" * 500 + "One. Two." + ")" * 500 + " Then three.")) <= 3
    long = "'" + "word " * 3000 + "so,' he said. Then he left."
    assert len(S.split(long)) == 2


@pytest.mark.parametrize(
    "known, text, n",
    [
        ("The zorb. value and the zorb. limit are set.", "We met at the zorb. Miller Hall again. It was late.", 2),
        ("Der Klst. wert und die klst. grenze gelten.", "Er nahm die klst. Hansen sehr ernst. Dann ging er.", 2),
        ("La vlmr. moyenne et la vlmr. basse sont là.", "Il donne la vlmr. Dupont du mois. Puis il part.", 2),
        ("El trqn. medio y el trqn. bajo valen.", "Dio el trqn. Ruiz del mes. Luego salió.", 2),
        ("Se hylk. arvo ja hylk. raja ovat tässä.", "Hän antoi hylk. Virtasen heti. Sitten hän lähti.", 2),
    ],
)
def test_abbreviations_on_no_list(known, text, n):
    """What the document itself shows before a lower-case word is an abbreviation before a capital too; without it, it isn't."""
    both = f"{known}\n\n{text}"
    assert sum(a >= len(known) for a, _ in S.split(both)) == n
    assert len(S.split(text)) == n + 1


def test_the_corpus_tells_what_no_list_knows(spark, monkeypatch):
    """Invented abbreviations before numbers and names, in documents that don't show them otherwise; both lists are emptied."""
    monkeypatch.setattr(S, "BEFORE", set())
    monkeypatch.setattr(S, "EITHER", set())
    kinds = [
        ("The load is zorb. {n} on and on.", 0), ("Der Wert klst. {n} gilt.", 0), ("La part vlmr. {n} reste.", 0), ("El tipo trqn. {n} vale.", 0),
        ("Arvo hylk. {n} on hyvä.", 0), ("मूल्य टी. {n} है।", 0)
    ]
    rows = [
        (
            i, kinds[i % 6][0].format(n=i) + (" It was late here so far. The end of it is late. It went on to the day here." if i % 6 == 0 else "")
        ) for i in range(180)
    ]
    got = S.sentences(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("doc_id").count().collect()
    assert {(r.doc_id % 6, r["count"]) for r in got} == {(0, 4), (1, 1), (2, 1), (3, 1), (4, 1), (5, 1)}
