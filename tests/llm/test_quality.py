import random
import re
from collections import Counter

import numpy as np

from tallyframe.llm import quality


def reference(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) for j in range(3) if windows[tuple(words[i : i + 3])] > 1}
    lines = [s for s in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioubdlmnrst") for _ in range(rng.randint(3, 8))) for _ in range(n)) + "."


def corpus():
    rng = random.Random(1)
    rows = [(i, prose(rng, 80) + "\n" + prose(rng, 40)) for i in range(200)]
    rows += [(1000 + i, " ".join(w + "$$$" for w in prose(rng, 100).split())) for i in range(20)]
    rows += [(2000 + i, prose(rng, 100).upper()) for i in range(20)]
    rows += [(3000 + i, (prose(rng, 8) + "\n") * 30) for i in range(20)]
    return rows + [(4000 + i, prose(rng, 20)) for i in range(20)]


def test_counts():
    rng = random.Random(2)
    texts = ["", " \n\t", "a b c a b c", "x\x1cy z\x85 \xa0 w　v u", "a\r\na\r\n\x0b\na", "#|<>&%$* #", "e " * 60_000, "é😀 漢字\n" * 3]
    texts += ["".join(rng.choice("ab \n\t#\xa0 ") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    assert [quality.measure(t)[:5] for t in texts] == [reference(t) for t in texts]


def test_bad_documents_go_and_clean_ones_stay(spark):
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in corpus()], "doc_id long, text string, votes int, kept string")
    found = {r.doc_id: r for r in quality.judge_quality(df).collect()}
    assert {i for i, r in found.items() if r.kept} == set(range(200))
    assert {i for i, r in found.items() if r.base_failed} == {*range(3000, 3020), *range(4000, 4020)}


SCRIPTS = {
    "arabic": ("ذهب الولد إلى المدرسة في الصباح الباكر وقرأ كتابا جديدا عن تاريخ المدينة القديمة", "؟"),
    "hindi": ("वह सुबह जल्दी उठकर नदी के किनारे टहलने गया और वहाँ उसने अपने पुराने मित्र को देखा", "।"),
    "korean": ("그는 아침 일찍 일어나 강가를 천천히 걸으며 오랜 친구에게 보낼 편지를 생각했다 그리고 웃었다", "."),
    "chinese": ("他 早上 很早 起床 沿着 河边 散步 看见 了 多年 不见 的 老 朋友", "。"),
    "chinese phrases": ("他早上很早就起床 沿着河边慢慢地散步，看见了多年不见的老朋友 想着要写一封信 天气很好 风从山上吹来 孩子们在桥上唱歌 "
                        "卖花的人走过街角 远处传来钟声 他们坐在树下喝茶 谈起从前的事情 太阳慢慢升高 回家的路还很长", "。"),
    "thai": ("เขาตื่นแต่เช้า เดินเล่นริมแม่น้ำ คิดถึงเพื่อนเก่า เขียนจดหมายถึงแม่ ฝนตกเบาๆ เด็กร้องเพลงบนสะพาน ลมพัดมาจากภูเขา "
             "คนขายดอกไม้เดินผ่าน เสียงระฆังดังมา นั่งดื่มชาใต้ต้นไม้ พระอาทิตย์ขึ้นช้าๆ ทางกลับบ้านยังไกล", "ฯ"),
    "greek": ("ξύπνησε νωρίς το πρωί και περπάτησε δίπλα στο ποτάμι με έναν παλιό φίλο", "."),
    "cyrillic": ("он проснулся рано утром и пошёл вдоль тихой реки навстречу старому верному другу", "."),
}


def script_text(rng, name):
    words, end = SCRIPTS[name]
    return "\n".join(" ".join(rng.sample(words.split(), 10)) + end for _ in range(25))


def test_prose_of_every_script_is_kept(spark):
    rng = random.Random(5)
    rows = corpus()
    rows += [(10_000 + 100 * k + i, script_text(rng, name)) for k, name in enumerate(SCRIPTS) for i in range(10)]
    # Words without letters, and signs among the words, are defects in every script.
    rows += [(20_000 + i, "".join(rng.choice("١٢٣٤٥ \n") for _ in range(900))) for i in range(10)]
    rows += [(21_000 + i, script_text(rng, "hindi").replace(" ", "$$ ")) for i in range(10)]
    found = {r.doc_id for r in quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.kept}
    wanted = {*range(200), *(10_000 + 100 * k + i for k in range(len(SCRIPTS)) for i in range(10))}
    assert found == wanted


def test_texts_of_any_kind(spark):
    rows = [(1, None), (1, ""), (None, "few words"), (2, "word " * 40_000), (2, "word " * 40_000), (3, "漢" * 100_000)]
    df = spark.createDataFrame([(i, t, None) for i, t in rows], "doc_id long, text string, posterior string")
    found = quality.judge_quality(df).collect()
    assert len(found) == len(rows) and not any(r.kept for r in found) and all(0 <= r.posterior <= 1 for r in found)
    assert quality.judge_quality(df.limit(0)).collect() == []


def test_estimate_from_counts_is_that_from_documents():
    rng = np.random.default_rng(3)
    good = rng.random(4000) < 0.8
    right = np.array([0.9, 0.8, 0.7, 0.95])
    votes = np.where(rng.random((4000, 4)) < right, np.where(good, 1, -1)[:, None], np.where(good, -1, 1)[:, None])
    votes[rng.random(votes.shape) < 0.3] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    one = quality.fit_votes(patterns, counts.astype("float64"))
    each = quality.fit_votes(votes, np.ones(4000))
    assert np.allclose(one.when_good, each.when_good) and np.isclose(one.good, each.good)
    assert ((one.posterior(votes) >= 0.5) == good).mean() > 0.93
    assert quality.fit_votes(np.zeros((0, 4)), np.zeros(0)) is None
