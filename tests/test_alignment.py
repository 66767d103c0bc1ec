"""Alignment rules of the reranker: each with a question and a text that meet it, its parent alone, and its exceptions."""

import pytest
from pyspark.sql import functions as F

from siltstone.operators import rerank

CASES = [
    ("客户手机号的处理时限", "数据范围=包含客户手机号; 处理时限=2天; 脱敏要求=掩码", {"phone", "phone_limit", "phone_masking"}),
    ("处理时限是多少", "数据范围=包含客户手机号; 处理时限=2天", set()),
    ("客户数据导出的审批、证据和时限", "事项=客户数据导出; 审批人=甲; 证据要求=截图; 时限=1天", {"export", "export_proof", "export_approver", "export_limit"}),
    ("客户数据导出", "事项=客户数据导出; 审批人=甲; 证据要求=截图; 时限=1天", {"export"}),
    ("导出的审批", "事项=客户数据导出; 审批人=甲", set()),
    ("由谁审批", "共同审批并将审批记录归档", {"approval", "approval_named"}),
    ("审批的负责人", "审批记录应归档", {"approval", "approval_archive"}),
    ("谁来审批", "由法务部和财务部审批", {"approval", "approval_named"}),
    ("审批时限", "审批人=甲", set()),
    ("临时高权限访问 的 审批 证据 时限", "事项=临时高权限访问; 审批人=乙; 时限=4小时; 证据要求=工单", {"access", "access_approver", "access_limit", "access_proof"}),
    ("Scan A 的动作", "编号=SCAN A; 动作=删除", {"scan", "scan_action"}),
    ("扫描A 是什么", "编号=扫描A; 动作=删除", {"scan"}),
    ("哪些检查项", "版本更新检查清单; 是否必须=必须", {"checks", "checks_required"}),
    ("制度版本发生变化", "知识库维护动作", {"changed_version"}),
    ("制度版本发生变化的检查项", "知识库维护动作 版本更新检查清单", {"checks"}),
    ("L4 供应商", "准入等级=L4高风险; 审批链路=甲; 复核周期=季度; 退出要求=回收", {"supplier", "supplier_approval", "supplier_review", "supplier_exit"}),
    ("生产环境", "访问对象=生产环境; 允许方式=堡垒机; 有效期=7天; 回收责任人=丙; 日志要求=全量", {"production", "production_way", "production_term", "production_owner", "production_logs"}),
    ("测试环境", "访问对象=生产环境; 允许方式=堡垒机", set()),
    ("数据处理服务", "交付类型=数据处理服务; 验收材料=报告; 验收人=丁; 保留期限=5年", {"processing", "processing_material", "processing_acceptor", "processing_retention"}),
    ("what", "访问对象=生产环境", set()), ("", "", set()), (None, None, set()),
]


def test_every_rule_has_a_case():
    assert {n for *_, names in CASES for n in names} == {r.name for r in rerank.ENTERPRISE_ALIGNMENT}


def test_rules(spark):
    rows = spark.createDataFrame([(i, q, t) for i, (q, t, _) in enumerate(CASES)], "id int, q string, t string")
    q, t = rerank._flat("q"), rerank._flat("t")
    holds = rerank.holding(q, t, rerank.ENTERPRISE_ALIGNMENT)
    bonus = rerank.pair_bonus(q, t, rerank.Rules(pairs=()))
    got = {r.id: r for r in rows.select("id", *[c.alias(n) for n, c in holds.items()], bonus.alias("bonus")).collect()}
    worth = {r.name: r.bonus for r in rerank.ENTERPRISE_ALIGNMENT}
    for i, (*_, names) in enumerate(CASES):
        assert {n for n in holds if got[i][n]} == names, CASES[i]
        assert got[i].bonus == pytest.approx(sum(worth[n] for n in names)), CASES[i]


def test_rules_decide_the_order(spark):
    """Of two texts that are alike otherwise, the one that fits the question's rules comes first."""
    text = {"a": "访问对象=测试环境; 允许方式=堡垒机", "b": "访问对象=生产环境; 允许方式=堡垒机"}
    rows = spark.createDataFrame([(1, "生产环境的允许方式", k, i, "t", v, 0.5, 0.1, ["lexical"]) for i, (k, v) in enumerate(text.items())], "query_id int, query_text string, chunk_id string, chunk_index int, document_title string, content string, fused double, lexical_raw double, sources array<string>")
    got = rerank.heuristic_rerank(rows, 2).orderBy("rank").collect()
    plain = rerank.heuristic_rerank(rows, 2, rerank.Rules(alignment=())).where(F.col("chunk_id") == "b").first()
    assert [r.chunk_id for r in got] == ["b", "a"] and got[0].rerank > plain.rerank + 0.6
