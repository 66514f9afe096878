import random

import numpy as np

from quirefold.llm import subjects as S

TOPICS = {"law": "judge court verdict appeal clause docket", "sport": "goal match league trophy referee stadium", "music": "chord melody violin tempo chorus opera"}
NEUTRAL = "lamp river stone window road harbor evening quiet old small walked stood remembered"


def documents(n, seed):
    draw = random.Random(seed)
    rows = []
    for k in range(n):
        subjects = draw.sample(sorted(TOPICS), draw.choice([0, 1, 1, 2]))
        sentences = []
        for s in subjects:
            sentences += [f"The {draw.choice(TOPICS[s].split())} and the {draw.choice(TOPICS[s].split())} were {draw.choice(NEUTRAL.split())}." for _ in range(4)]
        if draw.random() < 0.3:  # in passing
            s = draw.choice(sorted(TOPICS))
            if s not in subjects:
                sentences.append(f"One {draw.choice(TOPICS[s].split())} stood by.")
        sentences += [f"The {draw.choice(NEUTRAL.split())} was {draw.choice(NEUTRAL.split())} by the {draw.choice(NEUTRAL.split())}." for _ in range(5)]
        draw.shuffle(sentences)
        rows.append((k, " ".join(sentences), "web", subjects))
    return rows


def test_sentences():
    s = S.split(["One two. Three!\n\nFour five? “Six.” Seven", "", "...", "no end"])
    assert s.document.tolist() == [0, 0, 0, 0, 0, 3] and np.bincount(s.sentence).tolist() == [2, 1, 2, 1, 1, 2]


def test_held_out_accuracy():
    rows = documents(600, 1)
    names = sorted(TOPICS)
    labels = np.array([[float(n in r[3]) for n in names] for r in rows])
    noisy = labels.copy()
    for k in range(0, 400, 25):  # some labels are wrong
        noisy[k] = 0
    model = S.train([r[1] for r in rows[:400]], [r[2] for r in rows[:400]], noisy[:400], names)
    decided, chance = model.decide(S.split([r[1] for r in rows[400:]]), [r[2] for r in rows[400:]])
    want = labels[400:]
    assert 2 * (decided * want).sum() / (decided.sum() + want.sum()) > 0.95
    assert ((chance >= 0) & (chance <= 1)).all()


def test_assign(spark):
    rows = documents(200, 2)
    d = spark.createDataFrame([(k, t, s, "clash") for k, t, s, _ in rows] + [(900, None, "web", ""), (901, " ", None, ""), (902, rows[0][1], "new", "")], "doc_id long, text string, source string, subject string")
    labels = [(k, s) for k, _, _, own in rows[:150] for s in (own or [None])] + [(1, None), (5000, "law"), (2, "unknown")]
    lab = spark.createDataFrame(labels + labels[:5], "doc_id long, subject string")
    sub = spark.createDataFrame([(s,) for s in TOPICS] + [(None,), ("law",)], "subject string")
    got = S.assign(d, lab, sub).collect()
    found = {}
    for r in got:
        found.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(found.get(k, set()) == set(own) for k, _, _, own in rows[150:])
    assert right >= 45 and not {900, 901} & set(found) and found.get(902) == found.get(0)
    assert len(got) == len({(r.doc_id, r.subject) for r in got})
    assert S.assign(d, lab.limit(0), sub).count() == 0 and S.assign(d.limit(0), lab, sub).count() == 0 and S.assign(d, lab, sub.limit(0)).count() == 0
