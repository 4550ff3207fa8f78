from __future__ import annotations

import pytest

from profiles import PROPERTIES
from paceline.plans.analytics import Analytics
from paceline.plans.reports import conversion_blockers, upgrade_paths, weekly_health
from paceline.session import scratch_path
from paceline.operators.funnel import funnel_reach, funnel_steps_table
from paceline.sources.segments import SegmentStore

STEPS = "a, b, c"


@pytest.fixture(scope="module")
def tools(spark, make_log, make_users):
    events = [(u, "a", u % 10) for u in range(120)]
    events += [(u, "x", u % 10 + 1) for u in range(0, 120, 2)]
    events += [(u, "b", u % 10 + 2) for u in range(60)] + [(u, "c", u % 10 + 3) for u in range(30)]
    users = [(u, "pro" if u < 55 else "free", "de" if u % 2 else "fr") for u in range(120)]
    return Analytics(
        make_log(events), make_users(users), PROPERTIES, SegmentStore(spark, scratch_path(spark, "segments"))
    )


def test_chain_of_analyses(tools):
    funnel = tools.funnel_analysis(
        STEPS, "90", breakdown_property="plan", export_stalled_at_step="1", export_converted="true", segment_name="s"
    )
    assert [r.users for r in funnel["steps"].collect()] == [120, 60, 30]
    assert funnel["summary"].first().lost_users == 60
    assert funnel["breakdown"].count() == 6
    found = tools.segment_event_discovery("s_converted", top_n="3")
    assert found["rows"].first().event == "c" and found["summary"].first().direction == "over"
    assert tools.profile_segment("s_stalled", "0.2")["deviations"].first().value == "free"
    with pytest.raises(ValueError):
        tools.segment_event_discovery("nobody")
    with pytest.raises(ValueError):
        tools.funnel_analysis(STEPS, export_converted=True)


def test_other_tools(tools):
    weekly = tools.insight_query("a", by_week="true")
    assert [r.value for r in weekly["rows"].collect()] == [84, 36]
    assert weekly["total"].first().value == 120
    members = tools.segment_definition("doers", event_filters=[{"event": "x", "count": "1"}])["members"]
    assert members.count() == 60
    assert tools.product_paths("a", "c")["paths"].first().completed_users == 30
    journey = tools.journey_map("a", "c", segment="doers")
    assert journey["summary"].first().started_users == 60
    assert journey["paths"].first().path == "a -> x -> b -> c"
    assert journey["nodes"].filter("step = 0").first().users == 60
    top = tools.funnel_breakdown("a, b")["top"]
    assert {(r.kind, r.value) for r in top.filter("property = 'plan'").collect()} == {
        ("booster", "pro"), ("blocker", "free"),
    }
    assert tools.drilldown(STEPS)["report"].first().users == 120
    assert {r.event for r in tools.catalog()["events"].collect()} == set("abcx")


def sections(frame):
    found = {}
    for r in frame.collect():
        found.setdefault(r.section, []).append(r.item)
    return found


def test_reports(tools):
    log, users, store = tools.log, tools.users, tools.store
    blockers = sections(conversion_blockers(log, users, store, STEPS, PROPERTIES, stalled_at_step=2, base_name="f"))
    assert blockers["funnel"] == ["1 a", "2 b", "3 c"] and "c" in blockers["event"]
    upgrade = sections(upgrade_paths(log, users, store, goal="c", path_start="a", journey_start="b", segment_name="doers"))
    assert upgrade["path"] and upgrade["journey"][0] == "1 b" and set(upgrade["event"]) == set("abcx")
    health = sections(
        weekly_health(log, users, PROPERTIES, signup_events="a", engagement_events="b, c, x", steps=STEPS)
    )
    assert len(health["signups"]) == 2 and "plan=free" in health["blocker"]


def test_bucketed_log_is_not_shuffled_again(spark, tools):
    """A log bucketed by user reaches the per-user step without an exchange."""
    tools.log.write.mode("overwrite").bucketBy(4, "user_id").saveAsTable("bucketed_log")
    bucketed = Analytics(spark.table("bucketed_log"), tools.users, PROPERTIES, tools.store)
    try:
        assert [r.users for r in bucketed.funnel_analysis(STEPS)["steps"].collect()] == [120, 60, 30]
        steps = funnel_steps_table(funnel_reach(spark.table("bucketed_log"), tools.users, STEPS), STEPS)
        assert [r.users for r in steps.collect()] == [120, 60, 30]
        plan = steps._jdf.queryExecution().executedPlan().toString()
        final = plan[plan.index("Final Plan") : plan.index("Initial Plan")]
        collected = final[final.index("collect_list") :]
        assert "Bucketed: true" in collected
        between = collected[: collected.index("Bucketed: true")]
        assert "Exchange hashpartitioning(user_id" not in between
    finally:
        spark.sql("DROP TABLE bucketed_log")
