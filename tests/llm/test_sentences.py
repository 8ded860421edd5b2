import random

import numpy as np
import pytest

from millrace.llm.sentences import N_STATES, OUT, STEP, batch_spans, left_automaton, prefix_states, right_automaton, spans, split_sentences, symbols_of, transduce

CASES = [
    "Dr. Hadrow came.| The report by A. M. Quillan covers it.",
    "It cost approx. 6.01 mm, i.e. more than allowed.| See Fig. 26 for more.",
    "The kit has screws, clips, etc.| The rest came at 7:14 a.m.| Nothing else did.",
    "It restarted at 4 p.m. on the bench.| Rig No. 3 holds.| No.| It fell from .28 to .17.",
    'The display read "stop. Call support." and then went dark.| "Is it empty?" the operator asked.| Yes!',
    "Pernick wrote: “The joint drifted.”| The last one (see the log. It is long.) held.",
    "It moved... then it stalled.| It stopped…| The end.| rosbag4 replay failed.",
    "He came from Tolvex Inc. and left.|It was late.| The E.M.A. unit is at https://a.example/p.7?id=3 now.",
    "Beim 4. Versuch galt: alles gut.| Es war am 12. März, z. B. Zangen, d. h. nichts.| Schrauben usw. fehlten.",
    "Die Frage: „Ist sie leer?“| Das Gelenk lief.| „Er ging. Bitte prüfen.“ stand im Protokoll.",
    "Mme Tarnow demande : « Le bac est-il vide ? »| Pourquoi ?| L'écart est d'env. 4,2 mm à pleine charge !| Voir l'art. 5.",
    "« La pince a redémarré. À revoir. » figurait ici.| M. Hadrow a noté, p. ex. les vis… puis rien.",
    "¿Por qué falló?| ¡La cinta!| El Sr. Ysmar revisó la núm. 74 a las 2 p. m. durante la noche.",
    "Зазор составил 5,1 мм, т. е. больше.| См. рис. 11 и табл. 18.| Вёл А. К. Зольвин.| «Сбой. Проверить.» — так записано.",
    "夹爪停止了。|日志写着「停止了！」，但是没有人。|真的吗？！|超出范围……随后断开。|他说：“好。再试。”然后离开。|v2.0版本正常。",
    "画面に『エラー！』と出て、消えました。|なぜ止まったのですか？|cfg.left.yamlを開くと動いた。",
    "सेंसर रुक गया।| डॉ. वेलमोर ने जाँच की।| “कैमरा रुक गया। फिर देखें।” ऐसा लिखा था।| क्यों?| ट्रे ठीक है।",
    "بلغ الفرق 5.0 ملم بعد التسليم.| لماذا توقف؟| قال «استبدل. أعد المحاولة.» ثم غادر.",
    "สายพานหยุดทำงานแล้ว| รุ่น v2.4 ของแขนกลถูกคัดออกค่ะ| พบ 37 รายการที่แขนกลหยุด",
    "Title\n\n|Text goes\non here.| Next.\r\n\r\n|- item one\n|- item. two\n|* x\n|1. No tray\n|2) It is.\n|7) no item",
    "2025-11-01 09:59:36 ERROR lost! Requeue. Done\n|[2025-12-20 15:24:21.131] INFO a. B\n|After that it\nended.",
    "He said (open and never closed.| Then it went on.| So \"did this.| It ended",
    "Open a new tab.| Then close it.| She loves modern art.| We went home.| The law is Art. 5 of it.",
    "Wait 10 min.| Then restart the arm.| The limit is at max.| The arm stopped.| Die max. Drehzahl war zu hoch.",
    "Take vitamin C.| It helps.| J. It was.| A. The first.| He left.| iPhone sales rose.| eBay fell.",
    "The U.S. Senate met.| They live in the U.S.| The rest do not.| The gap is 6 mm.| Arm three moved.",
    "x = [0x7f,\t0b101]\r\ny = x[::-1]\n\n|{\"stage\": \"a. B\", \"t\": 0.8}\n\n|| a | b |\n|---|---|",
]


@pytest.mark.parametrize("case", CASES[:-1])
def test_cases(case):
    parts = case.split("|")
    text = "".join(parts)
    assert [text[a:b] for a, b in spans(text)] == [p.strip() for p in parts if p.strip()]
    # and unchanged when read in small chunks
    assert spans(text, chunk=1) == spans(text) == spans(text, chunk=3)


def test_code_and_tables():
    assert len(spans('x = [0x7f,\t0b101]\r\ny = x[::-1]\n\n{"stage": "a. B", "t": 0.8}\n\n| a | b |\n|---|---|')) == 3


def test_thai_list_items():
    text = "1) รุ่น v1.4 ของถาด\n2) สายพานหยุด\n3. แขนกลหยุด"
    assert [text[a:b] for a, b in spans(text)] == text.split("\n")


def test_cover_everything():
    rng = random.Random(4)
    pieces = ["A b. ", "c! ", "\n", "\n\n", "- x ", "1. ", "“", "”", "(", ")", "。", "… ", "  ", "สาย ", "2025-01-01 10:00:00 z", "№", "﻿", "e.g. ", '"', "।", "👩‍🔧", "\r\n"]
    for _ in range(500):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 60)))
        got = spans(text)
        covered = np.zeros(len(text), int)
        for a, b in got:
            assert a < b and not text[a].isspace() and not text[b - 1].isspace()
            covered[a:b] += 1
        assert covered.max(initial=0) <= 1
        assert all(covered[i] == 1 or ch.isspace() for i, ch in enumerate(text))
        assert got == spans(text, chunk=1) == spans(text, chunk=7)


def test_scan_is_the_sequential_run():
    rng = np.random.default_rng(0)
    symbols = rng.integers(0, STEP.shape[1], 20_000)
    state, want = 0, []
    for i, s in enumerate(symbols):
        if OUT[state, s]:
            want.append(i)
        state = STEP[state, s]
    for chunk in (1, 17, 1000, 30_000):
        assert transduce(symbols, chunk).tolist() == want
    functions = np.stack([STEP[:, s] for s in symbols[:100]]).astype(np.int64)
    assert functions.shape[1] == N_STATES
    state = 0
    for first, s in zip(prefix_states(functions), symbols[:100]):
        assert first == state
        state = STEP[state, s]


def test_automata_read_in_chunks_as_at_once():
    """Chunks are functions of states, composed by a scan: any cut gives the states of one serial run."""
    rng = random.Random(8)
    pieces = ["z. B. ", "aaaa", "Dr", ".", " ", "12", "März", "中文", "é", ",", "\n", "U.S.", "x_1", "(", "»", "ab.cd.ef", "iP", "k"]
    text = "".join(rng.choice(pieces) for _ in range(3000)) + "a" * 3000 + "ab." * 500
    sym = symbols_of(np.array([ord(c) for c in text], np.uint32))
    for made, _ in (left_automaton(), right_automaton()):
        state, want = 0, []
        for s in sym.tolist():
            state = int(made.step[state, s])
            want.append(state)
        for chunk in (1, 2, 7, 64, 256, 100_000):
            assert made.run(sym, chunk).tolist() == want


def test_texts_read_together_are_read_apart():
    rng = random.Random(5)
    texts = [None, "", " ", *["".join(p for p in c.split("|")) for c in CASES]] * 3
    rng.shuffle(texts)
    at, start, end = batch_spans(texts)
    got = {}
    for i, a, b in zip(at.tolist(), start.tolist(), end.tolist()):
        got.setdefault(i, []).append((a, b))
    assert all(got.get(i, []) == spans(t) for i, t in enumerate(texts))


def test_table(spark):
    rows = [(1, "One. Two."), (2, None), (3, " \n　 "), (4, ""), (1, "One. Two."), (None, "X")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' as start_char")
    got = sorted(map(tuple, split_sentences(df, with_text=True).collect()), key=str)
    assert got == [(1, 0, 4, "One."), (1, 0, 4, "One."), (1, 5, 9, "Two."), (1, 5, 9, "Two."), (None, 0, 1, "X")]
    assert split_sentences(df.limit(0)).count() == 0
    long = "It ran well. " * 50_000
    assert len(spans(long)) == 50_000
