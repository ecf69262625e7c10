"""Scenario and hazard tags of texts by the rules of a taxonomy, the same for chunks and requests; themes of tasks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.layout import by_prefix
from gristmill.functions.text import any_of, ordered_tags

# Tags with rules of their own.
HEIGHT, FALL, SCAFFOLD, SCAFFOLD_USE, COLLAPSE, SHOCK = "高处作业", "高处坠落", "脚手架", "脚手架使用", "坍塌", "触电"
THEMES = (
    ("脚手架", ("脚手架搭设", "脚手架拆除", "脚手架使用", "模板支架")),
    ("临时用电", ("临时用电", "配电箱", "漏电保护", "接地接零", "触电")),
    ("起重吊装", ("起重吊装", "塔式起重机", "施工升降机", "施工机械", "机械伤害", "起重伤害")),
    ("高处作业", ("高处作业", "临边作业", "洞口作业", "攀登作业", "悬空作业", "安全带", "安全网", "坠落防护", "操作平台", "高处坠落")),
)
THEME_OF_ACCIDENT = {"高处坠落": "高处作业", "物体打击": "高处作业", "坍塌": "脚手架", "起重伤害": "起重吊装", "机械伤害": "起重吊装", "触电": "临时用电"}


@dataclass(frozen=True)
class Taxonomy:
    """Rules are (needle, tag), in the order of their tags; hints are scenario and hazard tags by the prefix of a code."""

    # The defaults below.
    scenario_rules: Sequence[Sequence[str]] = ()
    hazard_rules: Sequence[Sequence[str]] = ()
    high_altitude_keywords: Sequence[str] = ("高处", "坠落", "临边", "洞口", "安全带", "安全网", "攀登", "悬空")
    high_altitude_scenario_tags: Sequence[str] = ("高处作业", "临边作业", "洞口作业", "攀登作业", "悬空作业", "安全带", "安全网", "坠落防护")
    collapse_scenario_tags: Sequence[str] = ("脚手架搭设", "脚手架拆除", "模板支架")
    standard_tag_hints: Mapping[str, Mapping[str, Sequence[str]]] = field(default_factory=dict)
    scenario_fallback: Sequence[str] = ("脚手架使用",)
    hazard_fallback: Sequence[str] = ("构件失稳",)

    def overlaid(self, values: Mapping) -> Taxonomy:
        """With the entries of `values` that are known and not null."""
        known = {f.name for f in fields(self)}
        return replace(self, **{k: v for k, v in values.items() if k in known and v is not None})


def read_taxonomy(path: str) -> Taxonomy:
    """The defaults, overlaid with a YAML file on the driver."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return Taxonomy().overlaid(yaml.safe_load(f) or {})


def _tags(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _hints(taxonomy: Taxonomy, code: Column | None, kind: str) -> Column:
    if code is None:
        return _tags(())
    return by_prefix(code, {p: list((h or {}).get(kind) or ()) for p, h in taxonomy.standard_tag_hints.items()})


def scenario_tags(text: Column, taxonomy: Taxonomy, code: Column | None = None) -> Column:
    """Work at height if a word of it occurs, tags by rules, use of scaffolds, hints of the code; each once. Null text has the hints only."""
    text = F.coalesce(text, F.lit(""))
    height = F.when(any_of(text, taxonomy.high_altitude_keywords), _tags((HEIGHT,))).otherwise(_tags(()))
    ruled = ordered_tags(text, [tuple(r) for r in taxonomy.scenario_rules], height)
    scaffold = F.when(F.contains(text, F.lit(SCAFFOLD)), _tags((SCAFFOLD_USE,))).otherwise(_tags(()))
    return F.array_distinct(F.concat(ruled, scaffold, _hints(taxonomy, code, "scenario")))


def hazard_tags(text: Column, scenarios: Column, taxonomy: Taxonomy, code: Column | None = None) -> Column:
    """Tags by rules; falls come first where scenarios tell of height and no rule gave them; collapse and hints follow."""
    ruled = ordered_tags(F.coalesce(text, F.lit("")), [tuple(r) for r in taxonomy.hazard_rules], _tags(()))
    high = F.arrays_overlap(scenarios, _tags(taxonomy.high_altitude_scenario_tags)) & ~F.array_contains(ruled, FALL)
    falls = F.when(high, _tags((FALL,))).otherwise(_tags(()))
    collapse = F.when(F.arrays_overlap(scenarios, _tags(taxonomy.collapse_scenario_tags)), _tags((COLLAPSE,))).otherwise(_tags(()))
    return F.array_distinct(F.concat(falls, ruled, collapse, _hints(taxonomy, code, "hazard")))


def or_fallback(scenarios: Column, hazards: Column, taxonomy: Taxonomy) -> Column:
    """Struct of scenarios and hazards, none of them empty."""
    falls = F.when(F.arrays_overlap(scenarios, _tags(taxonomy.high_altitude_scenario_tags)), _tags((FALL,))).otherwise(_tags(taxonomy.hazard_fallback))
    return F.struct(
        F.when(F.size(scenarios) > 0, scenarios).otherwise(_tags(taxonomy.scenario_fallback)).alias("scenarios"), F.when(F.size(hazards) > 0, hazards).otherwise(falls).alias("hazards")
    )


def theme(scenarios: Column, accident: Column) -> Column:
    """Electric shock decides; then the first theme that shares a tag; then the accident's own; else null."""
    out = F.lit(None).cast("string")
    for name, of in THEME_OF_ACCIDENT.items():
        out = F.when(accident == name, of).otherwise(out)
    for name, tags in reversed(THEMES):
        out = F.when(F.arrays_overlap(scenarios, _tags(tags)), name).otherwise(out)
    return F.when(accident == SHOCK, THEME_OF_ACCIDENT[SHOCK]).otherwise(out)
