"""Queries that read one table of facts let nothing else of a file's facts leave Python."""

import re

import pytest

from tessera.plans import catalogue, parsed  # noqa: F401  adds its queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name,columns", [("java_imports", {"qualname", "parse_error", "imports"}), ("typescript_declarations", {"qualname", "parse_error", "declarations"}), ("python_runtime_imports", {"path", "qualname", "parse_error", "all_exports", "dynamic_imports"})])  # F2, F5, F8
def test_facts_that_leave_python(spark, name, columns):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    (step,) = re.findall(r"MapInArrow \w+\(.*?\).*?, \[(.*?)\]", plan)
    assert {c.partition("#")[0].strip() for c in step.split(",")} <= columns
