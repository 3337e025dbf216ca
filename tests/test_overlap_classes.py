"""Overlaps by classes: as many rows pass the joins as there are pairs, and popular streets keep all of theirs."""

import random
from collections import Counter

import pytest

from zonewise.operators import validate

RULES = "id long, school_id long, locality string, street string, house_rule_raw string, house_number string, house_from int, house_to int, parity string"
SCHOOLS = "id long, name string"


def joined_rows(df) -> int:
    """Rows out of all joins of a plan that has run."""
    total, nodes = 0, [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            nodes.append(node.plan())
        else:
            if "Join" in kind:
                total += node.metrics().apply("numOutputRows").value()
            children = node.children()
            nodes += [children.apply(i) for i in range(children.size())]
    return total


@pytest.mark.parametrize("operator", [validate.intersections, validate.validate_rules])
def test_a_pair_is_joined_once(spark, operator):
    rules = spark.createDataFrame([(i, i, None, "А", "все", None, None, None, "all") for i in range(200)], RULES)
    found = operator(rules, spark.createDataFrame([(i, f"s{i}") for i in range(200)], SCHOOLS))
    assert len(found.collect()) == 199 * 100
    assert joined_rows(found) < 1.5 * 199 * 100


def test_popular_streets_keep_all_pairs(spark):
    r = random.Random(7)
    kinds = [("все", None, None, None, None), ("", "5,3", None, None, "odd"), ("", "3,5", None, None, None), ("", None, 4, 9, "even"), ("", None, 8, 6000, None), ("", None, 3, 3, "even")]
    rows = [(r.randrange(900) if i % 50 else None, r.choice([None, *range(5)]), None, r.choice(["ул. А", "а"]), *r.choices(kinds, [60, 5, 5, 5, 1, 2])[0]) for i in range(700)]
    # a kind's numbers: of "все" 1 to 300, the others below 10,000
    numbers = [set(range(1, 301)), {3, 5}, {3, 5}, {4, 6, 8}, set(range(8, 6001)), set()]
    shown = {(i, j): sorted(numbers[i] & numbers[j])[:10] for i in range(6) for j in range(6)}
    want = Counter()
    for a in rows:
        for b in rows:
            both = shown[kinds.index(a[4:]), kinds.index(b[4:])]
            if a[0] is not None and b[0] is not None and a[0] < b[0] and a[1] != b[1] and both:
                want[f"Пересечение правил по улице {a[3]}: дома {both}", a[0], b[0], f"s{a[1]}" if a[1] else "—", f"s{b[1]}" if b[1] else "—"] += 1
    assert sum(r[4] == "все" for r in rows) > 2 * validate.CHUNK
    got = validate.intersections(spark.createDataFrame(rows, RULES), spark.createDataFrame([(i, f"s{i}") for i in range(1, 5)], SCHOOLS))
    assert Counter((x["message"], x["rule_id"], x["second_rule_id"], x["school"], x["second_school"]) for x in got.collect()) == want
