"""Term schedules: priorities, groups and what groups need as tables, then a small helper that places a curriculum's groups."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syllagraph.storage import small_batches

from . import local
from .loops import components, joined

TARGET = 15.0
#: Fixed values by system: credits above the target that a term may reach, and terms at least.
SLACK = {False: 6.0, True: 4.0}
TERMS = {False: 8, True: 12}


def chain_flags(courses: DataFrame, edges: DataFrame) -> DataFrame:
    """courses with has_prereq, has_dependent, by prerequisite edges inside the plan."""
    ends = F.explode(F.array(F.struct(F.col("dst").alias("course_key"), F.lit(True).alias("pre")), F.struct(F.col("src").alias("course_key"), F.lit(False).alias("pre"))))
    flags = edges.filter("kind = 'prereq'").select("curriculum_id", ends.alias("e")).groupBy("curriculum_id", F.col("e.course_key").alias("course_key")).agg(F.bool_or("e.pre").alias("has_prereq"), F.bool_or(~F.col("e.pre")).alias("has_dependent"))
    has = [F.coalesce(c, F.lit(False)).alias(c) for c in ("has_prereq", "has_dependent")]
    return courses.join(flags, ["curriculum_id", "course_key"], "left").select(*courses.columns, *has)


def chain_priority(courses: DataFrame, edges: DataFrame, delays: DataFrame | None = None, *more: str) -> DataFrame:
    """Adds priority: courses that begin a chain first, then those inside one, then the rest, each by delay. Without delays the
    courses have them; more: other columns of the courses that stay."""
    on = ["curriculum_id", "course_key"]
    if delays is None:
        rows = chain_flags(courses.select(*on, *more, "delay"), edges)
    else:
        rows = chain_flags(courses.select(*on, *more), edges).join(delays.select(*on, "delay"), on, "left").withColumn("delay", F.coalesce("delay", F.lit(0)))
    score = F.when(~F.col("has_prereq") & F.col("has_dependent"), F.col("delay") * 10 + 100).when(F.col("has_dependent"), F.col("delay") * 5).otherwise(F.col("delay"))
    return rows.withColumn("priority", score.cast("bigint"))


def coreq_groups(courses: DataFrame, edges: DataFrame, small: bool = False) -> DataFrame:
    """curriculum_id, course_key, group_key: courses that corequisites join share the smallest key among them."""
    co = edges.filter("kind = 'coreq'").select("curriculum_id", "src", "dst")
    return components(courses.select("curriculum_id", F.col("course_key").alias("vertex")), co, small).select("curriculum_id", F.col("vertex").alias("course_key"), F.col("root").alias("group_key"))


def shared_groups(edges: DataFrame, small: bool = False) -> DataFrame:
    """The same without courses that no corequisite joins: the functions below take such a course as its own group."""
    return joined(edges.filter("kind = 'coreq'"), small).select("curriculum_id", F.col("vertex").alias("course_key"), F.col("root").alias("group_key"))


def with_group(rows: DataFrame, groups: DataFrame, course: str = "course_key", name: str = "group_key") -> DataFrame:
    """rows with the group of a course."""
    own = groups.select("curriculum_id", F.col("course_key").alias(course), F.col("group_key").alias(name))
    return rows.join(own, ["curriculum_id", course], "left").withColumn(name, F.coalesce(name, course))


def member_rows(courses: DataFrame, priorities: DataFrame, groups: DataFrame) -> DataFrame:
    """Courses with credits, priority and group. Courses are only read where the priorities come without credits."""
    on = ["curriculum_id", "course_key"]
    return with_group(priorities if "credits" in priorities.columns else courses.select(*on, "credits").join(priorities, on), groups)


def group_table(courses: DataFrame, priorities: DataFrame, groups: DataFrame) -> DataFrame:
    """Per group: highest priority, credits, members, and whether no member has a prerequisite or dependent."""
    rows = member_rows(courses, priorities, groups)
    return rows.groupBy("curriculum_id", "group_key").agg(F.max("priority").alias("group_priority"), F.sum("credits").alias("group_credits"), F.count("*").alias("members"), F.bool_and(~F.col("has_prereq") & ~F.col("has_dependent")).alias("is_filler"))


@dataclass
class Terms:
    """Courses and credits of each term of one curriculum."""

    target: float
    most: float
    courses: list[list[str]] = field(default_factory=list)
    load: list[float] = field(default_factory=list)

    def grow(self, n: int) -> None:
        while len(self.courses) < n:
            self.courses.append([])
            self.load.append(0.0)

    def put(self, term: int, members: list[str], credits: float) -> None:
        self.courses[term] += members
        self.load[term] += credits

    def earliest_fit(self, start: int, credits: float) -> int:
        """The first term from start on that stays within the target, else within the most, else a new one."""
        self.grow(start + 1)
        for limit in (self.target, self.most):
            for t in range(start, len(self.load)):
                if self.load[t] + credits <= limit:
                    return t
        self.grow(len(self.load) + 1)
        return len(self.load) - 1

    def lightest_fit(self, credits: float) -> int:
        fits = [(load, t) for t, load in enumerate(self.load) if load + credits <= self.most]
        if not fits:
            self.grow(len(self.load) + 1)
            return len(self.load) - 1
        return min(fits)[1]


def group_order(rank: dict[str, tuple], needs: dict[str, list[str]]) -> list[str]:
    """Groups so that each follows those it requires; of the free ones, the lowest rank first. Where groups require each other in
    a circle, all go by rank alone."""
    followers: dict[str, list[str]] = {}
    for g, own in needs.items():
        for p in own:
            followers.setdefault(p, []).append(g)
    missing = {g: len(own) for g, own in needs.items()}
    free = [rank[g] for g, n in missing.items() if n == 0]
    heapq.heapify(free)
    order = []
    while free:
        g = heapq.heappop(free)[1]
        order.append(g)
        for f in followers.get(g, ()):
            missing[f] -= 1
            if missing[f] == 0:
                heapq.heappush(free, rank[f])
    return order if len(order) == len(rank) else sorted(rank, key=rank.__getitem__)


def even_out(terms: Terms, movable: dict[str, float], passes: int = 3) -> None:
    """Moves courses without requisites from terms well above the target to terms well below it."""
    target = terms.target
    for _ in range(passes):
        over = [t for t, load in enumerate(terms.load) if load > target + 3]
        under = [t for t, load in enumerate(terms.load) if load < target - 3 and terms.courses[t]]
        for t in over:
            if not under:
                break
            for c in [c for c in terms.courses[t] if c in movable]:
                to = next((u for u in under if u != t and terms.load[u] + movable[c] <= target + 1 and terms.load[t] - movable[c] >= target - 3), None)
                if to is not None:
                    terms.courses[t].remove(c)
                    terms.load[t] -= movable[c]
                    terms.put(to, [c], movable[c])


def place_groups(groups: list[dict], quarter: bool, target: float) -> list[tuple[int, int, str, float]]:
    """(term, pos, course_key, credits) of one curriculum. groups: group_key, priority, members [(course_key, credits)] in
    order, filler (no member has a prerequisite or dependent), light (its course has no requisite at all), needs (the groups
    that its members' prerequisites are in)."""
    credits = {c["course_key"]: c["credits"] for g in groups for c in g["members"]}
    members = {g["group_key"]: [c["course_key"] for c in g["members"]] for g in groups}
    total = {g: sum(credits[c] for c in own) for g, own in members.items()}
    chained = {g["group_key"]: g for g in groups if not g["filler"]}
    terms, term_of = Terms(target, target + SLACK[quarter]), {}
    terms.grow(TERMS[quarter])
    for g in group_order({k: (-g["priority"], k) for k, g in chained.items()}, {k: g["needs"] for k, g in chained.items()}):
        at = terms.earliest_fit(max((term_of[p] + 1 for p in chained[g]["needs"] if p in term_of), default=0), total[g])
        terms.put(at, members[g], total[g])
        term_of[g] = at
    for g in sorted(members.keys() - chained.keys()):
        terms.put(terms.lightest_fit(total[g]), members[g], total[g])
    even_out(terms, {c: credits[c] for g in groups if g["light"] for c in members[g["group_key"]]})
    return [(t + 1, i + 1, c, credits[c]) for t, own in enumerate(terms.courses) for i, c in enumerate(own)]


def group_rows(courses: DataFrame, edges: DataFrame, priorities: DataFrame, groups: DataFrame) -> DataFrame:
    """curriculum_id, group_key, priority, members, filler, light, needs: what placing looks at, one row per corequisite group.

    A group needs the other groups that prerequisites of its members are in. Groups further back needn't be listed: they are
    placed before those, and where groups stand in a circle, they do so by the direct needs too."""
    rows = member_rows(courses, priorities, groups)
    member = F.struct("course_key", F.col("credits").cast("double").alias("credits"))
    per = rows.groupBy("curriculum_id", "group_key").agg(F.max("priority").alias("priority"), F.sort_array(F.collect_list(member)).alias("members"), F.bool_and(~F.col("has_prereq") & ~F.col("has_dependent")).alias("filler"), F.bool_and(F.col("delay") <= 1).alias("light"))
    pairs = with_group(with_group(edges.filter("kind = 'prereq'"), groups, "src", "need"), groups, "dst")
    needs = pairs.filter("need <> group_key").groupBy("curriculum_id", "group_key").agg(F.collect_set("need").alias("needs"))
    return per.join(needs, ["curriculum_id", "group_key"], "left").withColumn("needs", F.coalesce("needs", F.array().cast("array<string>")))


def group_lists(column: pa.ListArray) -> Iterator[list[dict]]:
    """What place_groups takes of each curriculum of a batch, out of a column with a list of group_rows."""
    groups = column.flatten()
    members, needs = groups.field("members"), groups.field("needs")
    keys, credits = map(local.plain, members.flatten().flatten())
    need = local.plain(needs.flatten())
    courses = [{"course_key": k, "credits": c} for k, c in zip(keys, credits, strict=True)]
    flat = [local.plain(groups.field(c)) for c in ("group_key", "priority", "filler", "light")]
    rows = [{"group_key": g, "priority": p, "filler": f, "light": x, "members": courses[m], "needs": need[n]} for g, p, f, x, m, n in zip(*flat, local.cuts(members), local.cuts(needs), strict=True)]
    for own in local.cuts(column):
        yield rows[own]


def term_schedule(courses: DataFrame, edges: DataFrame, priorities: DataFrame, groups: DataFrame, curriculum: DataFrame, target: float = TARGET) -> DataFrame:
    """curriculum_id, term, pos, course_key, credits. Placing is sequential inside a curriculum, so each is one row of its
    groups; curricula are placed in parallel."""
    system = curriculum.select("curriculum_id", F.contains(F.lower("system_type"), F.lit("quarter")).alias("quarter"))
    found = group_rows(courses, edges, priorities, groups)
    per = found.groupBy("curriculum_id").agg(F.collect_list(F.struct(*[c for c in found.columns if c != "curriculum_id"])).alias("groups"))
    rows = per.join(system, "curriculum_id", "left").select("curriculum_id", F.coalesce("quarter", F.lit(False)).alias("quarter"), "groups")
    kind = courses.schema["curriculum_id"].dataType.simpleString()
    small_batches(courses.sparkSession)

    def run(stream):
        for batch in stream:
            placed, each = [], []
            for quarter, own in zip(batch.column(1).to_pylist(), group_lists(batch.column(2)), strict=True):
                before = len(placed)
                placed += place_groups(own, quarter, target)
                each.append(len(placed) - before)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(each)), each), pa.int64()))
            columns = list(zip(*placed, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.float64()), strict=True))], names=["curriculum_id", "term", "pos", "course_key", "credits"])

    return rows.mapInArrow(run, f"curriculum_id {kind}, term int, pos int, course_key string, credits double")


def term_totals(schedule: DataFrame) -> DataFrame:
    """Credits and courses of each used term."""
    return schedule.groupBy("curriculum_id", "term").agg(F.sum("credits").alias("term_credits"), F.count("*").alias("courses"))


def schedule_violations(schedule: DataFrame, edges: DataFrame, groups: DataFrame, curriculum: DataFrame, target: float = TARGET) -> DataFrame:
    """curriculum_id, problem, reason, course_key: requisites in the wrong terms, and terms above the most that hold more than
    one group. No row for a sound schedule. A prerequisite inside the course's own corequisite group (reason "own group") can't
    be earlier in any schedule; another one stands where groups require each other in a circle or a light course was moved."""
    at = schedule.select("curriculum_id", "course_key", "term")
    pairs = edges.join(at.select("curriculum_id", F.col("course_key").alias("src"), F.col("term").alias("src_term")), ["curriculum_id", "src"]).join(at.select("curriculum_id", F.col("course_key").alias("dst"), F.col("term").alias("dst_term")), ["curriculum_id", "dst"])
    wrong = pairs.filter("IF(kind = 'prereq', src_term >= dst_term, src_term <> dst_term)")
    wrong = with_group(with_group(wrong, groups, "src", "src_group"), groups, "dst", "dst_group")
    early = F.col("kind") == "prereq"
    reason = F.when(~early, "moved").when(F.col("src_group") == F.col("dst_group"), "own group").otherwise("order of groups")
    problem = F.when(early, "prerequisite not earlier").otherwise("corequisite in another term")
    wrong = wrong.select("curriculum_id", problem.alias("problem"), reason.alias("reason"), F.col("dst").alias("course_key"))
    most = F.lit(target) + F.when(F.contains(F.lower("system_type"), F.lit("quarter")), SLACK[True]).otherwise(SLACK[False])
    loads = with_group(schedule, groups).groupBy("curriculum_id", "term").agg(F.sum("credits").alias("load"), F.countDistinct("group_key").alias("groups"))
    heavy = loads.join(curriculum, "curriculum_id", "left").filter((F.col("load") > most) & (F.col("groups") > 1)).select("curriculum_id", F.lit("term too heavy").alias("problem"), F.lit("load").alias("reason"), F.lit("").alias("course_key"))
    return wrong.union(heavy)
