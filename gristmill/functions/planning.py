"""What is decided about a request without a model: its mode, hazards, queries and the defaults of a draft."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.text import any_of

# Words that tell a request's mode and hazards, and texts of plans and drafts.
QUESTION_WORDS = ("？", "?", "为什么", "为何", "如何", "怎么", "怎样", "是什么", "能不能", "可不可以", "要不要", "是否", "多少", "哪些", "哪个", "什么时候", "有没有", "该不该")
TRAINING_WORDS = ("培训", "交底", "班前", "安全教育", "培训材料")
HAZARD_WORDS = (
    (("脚手架", "高处", "临边", "洞口", "吊篮"), ("高处坠落", "物体打击")),
    (("脚手架", "支架", "模板", "坍塌"), ("坍塌",)),
    (("临时用电", "电", "电焊"), ("触电",)),
)
ANY_HAZARDS, MOST_HAZARDS = ("违章作业", "防护不到位", "人员误入危险区域"), 5
SCENARIO = "%s作业前，班组准备开展安全交底。现场应核查作业区域、防护设施、警戒隔离、人员资质和应急处置要求。"
TRAINING_WORD = "安全培训"
NORM_QUERIES, CASE_QUERIES = ("%s", "%s 规范 要求 安全 防护", "%s 作业前 交底 检查"), ("%s 事故 案例", "%s 高处坠落 物体打击")
QA_NORM_QUERIES, QA_CASE_QUERIES = ("%s", "%s 规范 要求 安全 防护", "%s 施工 安全 措施"), ("%s", "%s 事故 案例")
ANY_TOPIC = "本次作业"
DRAFT = {
    "scenario_description": "%s作业前，班组应完成安全交底和现场检查。",
    "hazard_identification_question": "请识别%s中的主要危险源，并说明应采取哪些控制措施。",
    "learner_evaluation_guide": "能说出%s的主要危险源、相应的规范要求和个人防护要求，即为合格。",
    "remedial_feedback_guide": "若漏答关键危险源或防护要求，应结合对应规范条文和事故案例重新讲解后再考核。",
}
EXPECTED_HAZARDS = ("高处坠落", "物体打击", "违章作业")
OPERATION_POINTS = (
    "作业前：核对%s专项方案和安全技术交底，确认作业人员已理解危险点和控制措施。",
    "作业前：检查作业环境、设备工具和个人防护用品，设置必要的警戒隔离和专人监护。",
    "作业中：严格按操作规程和审批的方案作业，不违章指挥、不违章操作、不冒险蛮干。",
    "作业中：正确佩戴和使用劳动防护用品，发现隐患立即停止作业并报告处理。",
    "作业后：清理现场、恢复安全状态，确认无遗留隐患后方可撤离。",
)
QUIZ = {"type": "true_false", "question": "进行%s时，只要赶进度，可以简化安全交底和防护措施。", "answer": "错误", "explanation": "任何作业都必须落实安全交底和防护措施，不得因赶进度而简化。"}


def _filled(texts: tuple[str, ...], value: Column) -> Column:
    return F.array(*[_about(t, value) for t in texts])


def _about(text: str, value: Column) -> Column:
    return F.format_string(text, value) if "%s" in text else F.lit(text)


def _tags(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def is_training(text: Column) -> Column:
    """Whether a request names training; then no model is asked."""
    return any_of(F.coalesce(text, F.lit("")), TRAINING_WORDS)


def intent(text: Column) -> Column:
    """training or qa: words of training win, then those of questions; a bare topic is training."""
    return F.when(~is_training(text) & any_of(F.coalesce(text, F.lit("")), QUESTION_WORDS), "qa").otherwise("training")


def scenario(topic: Column) -> Column:
    return _about(SCENARIO, F.coalesce(topic, F.lit("")))


def hazards(topic: Column, about: Column) -> Column:
    """Hazards of a topic and its scenario, each once; three general ones where no word tells of any."""
    text = F.concat_ws(" ", topic, about)
    found = F.array_distinct(F.flatten(F.array(*[F.when(any_of(text, words), _tags(names)).otherwise(F.array().cast("array<string>")) for words, names in HAZARD_WORDS])))
    return F.slice(F.when(F.size(found) > 0, found).otherwise(_tags(ANY_HAZARDS)), 1, MOST_HAZARDS)


def training_queries(topic: Column, about: Column) -> Column:
    """norm_queries and case_queries of a topic and its scenario."""
    base = F.trim(F.replace(F.trim(F.concat_ws(" ", topic, about)), F.lit(TRAINING_WORD), F.lit("")))
    base = F.coalesce(F.nullif(base, F.lit("")), topic)
    return F.struct(_filled(NORM_QUERIES, base).alias("norm_queries"), _filled(CASE_QUERIES, base).alias("case_queries"))


def qa_queries(question: Column) -> Column:
    """norm_queries and case_queries of a question, without its marks at the end."""
    base = F.regexp_replace(F.trim(F.coalesce(question, F.lit(""))), "[？?]+$", "")
    return F.struct(_filled(QA_NORM_QUERIES, base).alias("norm_queries"), _filled(QA_CASE_QUERIES, base).alias("case_queries"))


def with_defaults(topic: Column, about: Column, found: Column, known: dict[str, Column]) -> Column:
    """The seven fields of a draft; those of `known` that are not empty stay, the others get their defaults.

    about: the scenario, may be empty; found: hazards, of which five are expected, each
    cut at 30 characters.
    """
    of = F.coalesce(F.nullif(F.trim(F.coalesce(topic, F.lit(""))), F.lit("")), F.lit(ANY_TOPIC))
    text = lambda name, default: F.coalesce(F.nullif(known[name], F.lit("")), default) if name in known else default
    many = lambda name, default: F.when(F.coalesce(F.size(known[name]), F.lit(0)) > 0, known[name]).otherwise(default) if name in known else default
    expected = F.transform(F.slice(F.coalesce(found, F.array().cast("array<string>")), 1, MOST_HAZARDS), lambda h: F.substring(h, 1, 30))
    quiz = F.array(F.struct(F.lit(QUIZ["type"]).alias("type"), _about(QUIZ["question"], of).alias("question"), F.array().cast("array<string>").alias("options"), F.lit(QUIZ["answer"]).alias("answer"), F.lit(QUIZ["explanation"]).alias("explanation")))
    fields = {n: text(n, _about(t, of)) for n, t in DRAFT.items()}
    fields["scenario_description"] = text("scenario_description", F.coalesce(F.nullif(about, F.lit("")), _about(DRAFT["scenario_description"], of)))
    fields["expected_hazards"] = many("expected_hazards", F.when(F.size(expected) > 0, expected).otherwise(_tags(EXPECTED_HAZARDS)))
    fields["operation_points"] = many("operation_points", _filled(OPERATION_POINTS, of))
    fields["quiz_questions"] = many("quiz_questions", quiz)
    return F.struct(*[c.alias(n) for n, c in fields.items()])
