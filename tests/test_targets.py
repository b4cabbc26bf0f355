import random

from lectern.operators.targets import select_targets

SCHEMA = "doc_id long, seq int, id string, parent_id string, kind string, section string, anchor_text string, page_start int, sent_start int, rank int"


def plain(rows, most):
    out = {}
    for doc in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == doc), key=lambda r: r[1])
        score = lambda i, r: (r[4] == "abstract") * 3 + (len(r[6] or "") >= 24) * 2 + (r[7] is not None) + 0.5 * (r[8] is not None) + max(0, 0.5 - i * 0.001)
        order = [r for _, _, r in sorted((-round(score(i, r), 9), r[1], r) for i, r in enumerate(mine))]
        taken, sections, parents = [], {}, {}
        for diverse in (True, False):
            for r in order:
                section, parent = (r[5] or "").lower(), r[3] or r[2]
                if len(taken) < most and r[1] not in taken and parents.get(parent, 0) < 3 and (not diverse or sections.get(section, 0) < 2):
                    taken.append(r[1])
                    sections[section], parents[parent] = sections.get(section, 0) + 1, parents.get(parent, 0) + 1
        out |= {(doc, seq): i + 1 for i, seq in enumerate(taken)}
    return out


def test_against_one_after_another(spark):
    rnd = random.Random(21)
    rows = []
    for doc in [*range(12), None]:
        n_sections, n_parents = rnd.randint(1, 6), rnd.randint(1, 20)
        for seq in range(rnd.choice([1, 5, 60, 150])):
            rows.append((doc, seq, f"u{seq}", rnd.choice([None, *(f"p{i}" for i in range(n_parents))]), rnd.choice(["child", "child", "abstract"]), rnd.choice([None, "", *(f"Sec {i}" for i in range(n_sections)), "SEC 0"]),
                         rnd.choice([None, "short", "long enough to be an anchor"]), rnd.choice([None, 3]), rnd.choice([None, 1]), 7))
    frame = spark.createDataFrame(rows, SCHEMA)
    for most in (12, 5, 1):
        # None is a document too
        found = {(r.doc_id, r.seq): r["rank"] for r in select_targets(frame, most=most).collect()}
        assert found == {(None if d == -1 else d, s): k for (d, s), k in plain([(-1 if r[0] is None else r[0], *r[1:]) for r in rows], most).items()}
    assert select_targets(frame, most=0).collect() == [] and select_targets(frame.limit(0)).collect() == []
