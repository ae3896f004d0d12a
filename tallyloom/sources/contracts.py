"""Contracts of JSON documents of unknown shape: which sections and fields they must have, and of which kinds; checked on VARIANT values."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How Spark names the kinds of JSON values.
_NAMES = {"object": r"OBJECT", "list": r"ARRAY", "string": r"STRING", "integer": r"BIGINT", "number": r"(BIGINT|DOUBLE|DECIMAL)", "boolean": r"BOOLEAN", "null": r"VOID", "any": r""}


def is_kind(variant: Column, kind: str) -> Column:
    """Whether a value is of a kind: object, list, string, filled (a string that isn't empty), integer, number (an integer is one, a boolean isn't), boolean, null or any; a ? behind
    it allows null, too.

    False where there is no value.
    """
    if kind == "filled":
        return is_kind(variant, "string") & (F.try_variant_get(variant, "$", "string") != "")
    name = _NAMES[kind.rstrip("?")]
    pattern = f"^({name}|VOID)" if kind.endswith("?") else f"^{name}"
    return F.coalesce(F.schema_of_variant(variant).rlike(pattern), F.lit(False))


@dataclass(frozen=True)
class Section:
    """fields: kind by name of those that must be there; optional: of those that may. many: the section is a list of objects with these fields.

    lists: of optional fields that are lists of objects, what these have. open: other fields may be there, too.
    """

    fields: dict[str, str] = field(default_factory=dict)
    optional: dict[str, str] = field(default_factory=dict)
    many: bool = False
    lists: dict[str, Section] = field(default_factory=dict)
    open: bool = False


class Contracts:
    """Contracts by name: sections by name."""

    def __init__(self):
        self.known: dict[str, dict[str, Section]] = {}

    def register(self, name: str, sections: dict[str, Section]) -> dict[str, Section]:
        self.known[name] = sections
        return sections

    def get(self, name: str) -> dict[str, Section] | None:
        return self.known.get(name)

    def names(self) -> list[str]:
        return list(self.known)

    def check(self, rows: DataFrame, keys: list[str], json: str, name: str) -> DataFrame:
        """keys, path, code of what in a column of JSON texts breaks the contract: NO_CONTRACT, NO_OBJECT, MISSING, UNKNOWN, NOT_OBJECT, NOT_LIST, KIND.

        Sections are looked at first; what is in them only where all are there and no other. Texts that aren't JSON are NO_OBJECT, as are null ones. Paths are like questions[2].text.
        """
        sections = self.get(name)
        if sections is None:
            return rows.select(*keys, F.lit(name).alias("path"), F.lit("NO_CONTRACT").alias("code"))
        open_ = all(s.open for s in sections.values())  # then the document may have other sections, too
        issue = lambda path, code: F.struct((F.lit(path) if isinstance(path, str) else path).alias("path"), F.lit(code).alias("code"))
        none = F.array().cast("array<struct<path: string, code: string>>")
        some = lambda found: F.filter(F.array(*found), lambda x: x.isNotNull()) if found else none
        fields_of = lambda v: F.try_variant_get(v, "$", "map<string, variant>")
        once = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731 - x is made once, however often f has it

        def unknown(m: Column, known: list[str], path: Callable[[Column], Column]) -> Column:
            return F.transform(F.array_sort(F.array_except(F.map_keys(m), F.array(*map(F.lit, known)).cast("array<string>"))), lambda k: issue(path(k), "UNKNOWN"))

        def within(v: Column, path: Column, s: Section) -> Column:
            """What is wrong in an object, which is taken apart once: getting a value out of a VARIANT builds it anew."""
            known = {**s.fields, **s.optional}

            def of(m: Column) -> Column:
                single = []
                for k, kind in known.items():
                    at, x = F.concat(path, F.lit(f".{k}")), m[k]
                    wrong = F.when(x.isNotNull() & ~is_kind(x, kind), issue(at, "KIND"))
                    single.append(F.when(x.isNull(), issue(at, "MISSING")).otherwise(wrong) if k in s.fields else wrong)
                parts = [none if s.open else unknown(m, [*known, *s.lists], lambda k: F.concat(path, F.lit("."), k)), some(single)]
                parts += [F.when(m[k].isNotNull(), listed(m[k], F.concat(path, F.lit(f".{k}")), inner)).otherwise(none) for k, inner in s.lists.items()]
                return F.when(m.isNotNull(), F.concat(*parts)).otherwise(F.array(issue(path, "NOT_OBJECT")))

            return once(fields_of(v), of)

        def listed(v: Column, path: Column, s: Section) -> Column:
            each = lambda items: F.flatten(F.transform(items, lambda x, i: within(x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), s)))
            return once(F.try_variant_get(v, "$", "array<variant>"), lambda items: F.when(items.isNotNull(), each(items)).otherwise(F.array(issue(path, "NOT_LIST"))))

        whole = F.col("_m")
        outer = [some([F.when(whole[s].isNull(), issue(s, "MISSING")) for s in sections])]
        if not open_:
            outer.append(unknown(whole, list(sections), lambda k: k))
        inner = [listed(whole[k], F.lit(k), s) if s.many else within(whole[k], F.lit(k), s) for k, s in sections.items()]
        parsed = rows.select(*keys, fields_of(F.try_parse_json(json)).alias("_m"))
        found = parsed.withColumn("_outer", F.when(whole.isNotNull(), F.concat(*outer)).otherwise(F.array(issue("root", "NO_OBJECT"))))
        return found.select(*keys, F.inline(F.when(F.size("_outer") > 0, F.col("_outer")).otherwise(F.concat(*inner))))


#: The contracts of exam documents, of lists of outcomes and of students' answers.
CONTRACTS = Contracts()
CONTRACTS.register("exam", {
    "metadata": Section({"ced_version": "string", "created_at": "string", "source": "string"}, {"language": "string"}),
    "assessment": Section({"id": "string", "title": "string", "course": "string"}, {k: "string?" for k in ("education_level", "school_type", "grade", "exam_type", "exam_date", "component_type", "assessment_group_id", "weighting_profile_id")} | {"question_count": "integer?", "total_score": "number?"}),
    "questions": Section({"id": "string", "number": "integer"}, {"text": "string?", "max_score": "number?", "learning_outcome_ids": "list", "learning_outcome_weights": "object", "answer_key": "string?"}, many=True),
    "student_results": Section({"student_no": "string", "full_name": "string"}, {"answers": "list", "total_score": "number?"}, many=True, lists={"question_scores": Section({"question_id": "string"}, {"score": "number?"})}),
    "validation": Section({}, {"valid": "boolean", "warnings": "list"}, lists={"issues": Section({"code": "string", "message": "string"}, {"field": "string?", "severity": "string"})}),
})
CONTRACTS.register("outcomes", {"learning_outcomes": Section({"id": "filled"}, {"keywords": "list"}, many=True, open=True)})
CONTRACTS.register("answers", {"student_results": Section({"student_no": "filled", "full_name": "filled", "answers": "list"}, many=True, open=True)})
