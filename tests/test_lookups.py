"""Name resolution by the substring index against a scan of all pairs."""

import random

from panelkit.operators import lookups as LK


def _scan(name, entities, aliases):
    q = name.strip(" ").lower()
    same = [e for e in entities if e.lower() == q]
    if same:
        return min(same)
    part = [e for e in entities if q in e.lower() or e.lower() in q]
    return min(part) if part else {a.lower(): e for a, e in aliases}.get(q)


def test_resolution_equals_a_scan(spark):
    rng = random.Random(1)
    entities = {"".join(rng.choice("abÉé o'_1") for _ in range(rng.randint(1, 9))).strip() or "x" for _ in range(120)}
    entities |= {"Congo", "Democratic Republic of Congo", "Guinea", "Papua New Guinea", "El Salvador", "Viet Nam"}
    pool = sorted(entities)
    names = ["Congo", "guinea", "salvador", "vietnam", "zzz", " ", "", "new guinea and more", "c", "ab", "VIET NAM "]
    names += ["".join(rng.choice("abé o_1") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    names += [rng.choice(pool)[1:4] + rng.choice(["", "b"]) for _ in range(40)]
    asked = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, ord int")
    frame = spark.createDataFrame([(e,) for e in pool], "entity string")
    al = spark.createDataFrame(LK.ALIASES, "alias string, entity string")
    got = {r["ord"]: r["entity"] for r in LK.resolve_names(asked, frame, al).collect()}
    assert got == {i: _scan(n, pool, LK.ALIASES) for i, n in enumerate(names)}


def test_blank_entities_and_missing_names(spark):
    asked = spark.createDataFrame([("ab", 0), (None, 1), ("", 2)], "name string, ord int")
    some = spark.createDataFrame([("",), ("zz",), (None,)], "entity string")
    assert {r["ord"]: r["entity"] for r in LK.resolve_names(asked, some).collect()} == {0: "", 1: None, 2: ""}
    assert {r["entity"] for r in LK.resolve_names(asked, some.limit(0)).collect()} == {None}


def test_pairs_meet_by_equality_only(spark):
    asked = spark.createDataFrame([("ab", 0)], "name string, ord int")
    some = spark.createDataFrame([("abc",), ("zz",)], "entity string")
    plan = LK.resolve_names(asked, some)._jdf.queryExecution().optimizedPlan().toString()
    cross = [line for line in plan.splitlines() if "Join Inner" in line and " = " not in line and "Inner, (" not in line]
    assert len(cross) <= 2                      # the one-row sides of blank texts
