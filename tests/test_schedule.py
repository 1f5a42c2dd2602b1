"""Placing of one curriculum's groups by hand-made cases."""

from collections import Counter

from pyspark.sql import functions as F

from syllagraph.operators import schedule
from syllagraph.plans.frames import Frames


def place(courses, before=None, groups=None, delays=None, quarter=False, target=15.0, priority=None):
    """courses: key -> credits."""
    before, groups, delays, priority = before or {}, groups or {}, delays or {}, priority or {}
    needed = {p for own in before.values() for p in own}
    of = {c: groups.get(c, c) for c in courses}
    rows = []
    for g in sorted(set(of.values())):
        own = sorted(c for c in courses if of[c] == g)
        rows.append({"group_key": g, "priority": max(priority.get(c, 1) for c in own), "members": [{"course_key": c, "credits": float(courses[c])} for c in own], "filler": not any(before.get(c) or c in needed for c in own), "light": all(delays.get(c, 1) <= 1 for c in own) and len(own) == 1 and not (before.get(own[0]) or own[0] in needed), "needs": sorted({of[p] for c in own for p in before.get(c, ())} - {g})})
    return {c: term for term, _, c, _ in schedule.place_groups(rows, quarter, target)}


def test_chains_rise():
    got = place({"A": 3, "B": 3, "C": 3}, {"B": ["A"], "C": ["B"]})
    assert got["A"] < got["B"] < got["C"]


def test_groups_share_a_term():
    got = place({"A": 3, "L": 1, "B": 3}, {"B": ["A"]}, {"A": "A", "L": "A"})
    assert got["A"] == got["L"] < got["B"]


def test_fillers_spread_and_keep_to_the_most():
    got = place({f"c{i}": 4 for i in range(60)})
    assert max(Counter(got.values()).values()) * 4 <= 21 and len(got) == 60


def test_a_plan_grows_past_its_terms():
    n = 12
    got = place({f"c{i:02}": 3 for i in range(n)}, {f"c{i:02}": [f"c{i - 1:02}"] for i in range(1, n)})
    assert [got[f"c{i:02}"] for i in range(n)] == list(range(1, n + 1))


def test_quarters_have_their_own_most():
    got = place({"A": 10, "B": 9, "C": 2, "Z": 1}, {"Z": ["A", "B", "C"]}, quarter=True)
    load = {}
    for c, t in got.items():
        load[t] = load.get(t, 0) + {"A": 10, "B": 9, "C": 2, "Z": 1}[c]
    assert max(load.values()) <= 19


def test_priority_and_key_break_ties():
    rank = {"a": (-1, "a"), "b": (-5, "b"), "c": (-5, "c")}
    assert schedule.group_order(rank, {"a": [], "b": [], "c": []}) == ["b", "c", "a"]
    assert schedule.group_order(rank, {"a": [], "b": ["a"], "c": []}) == ["c", "a", "b"]


def test_groups_in_a_circle_go_by_rank():
    assert schedule.group_order({"a": (-1, "a"), "x": (-9, "x")}, {"a": ["x"], "x": ["a"]}) == ["x", "a"]


def test_light_courses_move_to_light_terms():
    terms = schedule.Terms(15, 21, [["A", "B", "C"], ["D"]], [19.0, 6.0])
    schedule.even_out(terms, {"B": 3.0})
    assert terms.courses == [["A", "C"], ["D", "B"]] and terms.load == [16.0, 9.0]


def test_placing_sees_one_row_per_group(spark, sf_dir):
    f = Frames(spark, sf_dir)
    rows = schedule.group_rows(f.course, f.key_edges, f.priorities, f.groups)
    assert rows.count() == f.groups.select("curriculum_id", "group_key").distinct().count()
    needs = rows.select("curriculum_id", "group_key", F.explode("needs").alias("need"))
    assert needs.join(rows.select("curriculum_id", F.col("group_key").alias("need")), ["curriculum_id", "need"], "left_anti").count() == 0
    assert needs.filter("need = group_key").count() == 0 and f.schedule.count() == f.course.count()


def plain_schedule(courses, before, groups, priority, quarter, target=15.0):
    """The rules told course by course: what a course requires however far back, then term by term."""
    most, loads, terms = target + (4 if quarter else 6), [0.0] * (12 if quarter else 8), {}
    behind = {}
    for c in courses:
        stack, seen = list(before.get(c, ())), set()
        while stack:
            p = stack.pop()
            if p not in seen:
                seen.add(p)
                stack += before.get(p, ())
        behind[c] = seen
    members = {}
    for c in sorted(courses):
        members.setdefault(groups[c], []).append(c)
    wanted = {p for own in before.values() for p in own}
    chained = [g for g, own in members.items() if any(before.get(c) or c in wanted for c in own)]
    rank = {g: (-max(priority[c] for c in members[g]), g) for g in members}
    needs = {g: {groups[p] for c in members[g] for p in behind[c]} - {g} for g in chained}
    order, rest = [], set(chained)
    while rest:
        free = [g for g in rest if not needs[g] & rest]
        if not free:
            order = sorted(chained, key=rank.get)
            break
        order.append(min(free, key=rank.get))
        rest.discard(order[-1])
    fits = lambda t, n, limit: loads[t] + n <= limit
    held = [[] for _ in loads]

    def put(t, own):
        for c in own:
            terms[c] = t
        held[t] += own
        loads[t] += sum(courses[c] for c in own)

    def appended():
        loads.append(0.0)
        held.append([])
        return len(loads) - 1

    for g in order:
        n, start = sum(courses[c] for c in members[g]), max((terms[p] + 1 for c in members[g] for p in before.get(c, ()) if p in terms), default=0)
        while len(loads) <= start:
            appended()
        spots = [t for t in range(start, len(loads)) if fits(t, n, target)] or [t for t in range(start, len(loads)) if fits(t, n, most)]
        put(spots[0] if spots else appended(), members[g])
    for g in sorted(set(members) - set(chained)):
        n = sum(courses[c] for c in members[g])
        spots = [t for t in range(len(loads)) if fits(t, n, most)]
        put(min(spots, key=lambda t: (loads[t], t)) if spots else appended(), members[g])
    lone = {c for g, own in members.items() if len(own) == 1 and g not in chained for c in own}
    for _ in range(3):
        over, under = [t for t in range(len(loads)) if loads[t] > target + 3], [t for t in range(len(loads)) if loads[t] < target - 3 and held[t]]
        for t in over:
            for c in [c for c in held[t] if c in lone]:
                for u in under:
                    if u != t and loads[u] + courses[c] <= target + 1 and loads[t] - courses[c] >= target - 3:
                        held[t].remove(c)
                        loads[t] -= courses[c]
                        put(u, [c])
                        break
    return {c: (t + 1, held[t].index(c) + 1) for t in range(len(held)) for c in held[t]}


def test_schedules_equal_the_rules(spark, sf_dir):
    f = Frames(spark, sf_dir)
    rows = f.priorities.join(f.groups, ["curriculum_id", "course_key"]).join(f.course.select("curriculum_id", "course_key", "credits"), ["curriculum_id", "course_key"]).collect()
    before, quarter, own, got = {}, {r.curriculum_id: "quarter" in r.system_type for r in f.curriculum.collect()}, {}, {}
    for e in f.key_edges.filter("kind = 'prereq'").collect():
        before.setdefault(e.curriculum_id, {}).setdefault(e.dst, []).append(e.src)
    for r in rows:
        own.setdefault(r.curriculum_id, []).append(r)
    for r in f.schedule.collect():
        got.setdefault(r.curriculum_id, {})[r.course_key] = (r.term, r.pos)
    for cid, rs in own.items():
        assert got[cid] == plain_schedule({r.course_key: r.credits for r in rs}, before.get(cid, {}), {r.course_key: r.group_key for r in rs}, {r.course_key: r.priority for r in rs}, quarter[cid]), cid
