"""Row validation by declared rules.

A rule is a named condition that marks a row as broken, with a message. Every
row keeps all its messages; nothing is dropped unless ``quarantine`` is asked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Getter = Callable[[str], Column]


@dataclass(frozen=True)
class Rule:
    name: str
    broken: Column
    message: str


@dataclass(frozen=True)
class Field:
    """Declared limits of one value."""

    name: str
    low: float | None = None
    high: float | None = None
    required: bool = False
    choices: tuple[str, ...] = ()
    kind: str | None = None


@dataclass(frozen=True)
class Check:
    """A condition over several fields of one block, as ``get -> broken``."""

    name: str
    needs: tuple[str, ...]
    broken: Callable[[Getter], Column]
    message: str


@dataclass(frozen=True)
class Model:
    """Fields, checks and fill-ins of one block, plus nested blocks."""

    name: str
    fields: tuple[Field, ...]
    checks: tuple[Check, ...] = ()
    # target field -> (fields it needs, get -> value); only fills missing values
    derive: dict[str, tuple[tuple[str, ...], Callable[[Getter], Column]]] = field(default_factory=dict)
    blocks: dict[str, tuple[Model, bool]] = field(default_factory=dict)


def _struct_of(data_type: T.DataType) -> T.StructType | None:
    if isinstance(data_type, T.ArrayType):
        data_type = data_type.elementType
    return data_type if isinstance(data_type, T.StructType) else None


def _field_tests(f: Field, value: Column, path: str) -> list[tuple[str, Column, str]]:
    tests = []
    if f.low is not None or f.high is not None:
        low = value < float(f.low) if f.low is not None else F.lit(False)
        high = value > float(f.high) if f.high is not None else F.lit(False)
        limits = f"[{'-inf' if f.low is None else f'{f.low:g}'}, {'inf' if f.high is None else f'{f.high:g}'}]"
        tests.append((f"{path}.range", low | high, f"{path}: outside {limits}"))
    if f.choices:
        tests.append((f"{path}.choices", ~value.isin(*f.choices), f"{path}: not an allowed value"))
    return tests


def _rules(model: Model, schema: T.StructType, get: Getter, path: str, wrap: Callable[[Column], Column]) -> list[Rule]:
    """``wrap`` turns a condition on one block into a condition on the row."""
    present = set(schema.fieldNames())
    dot = f"{path}." if path else ""
    out = []
    for f in model.fields:
        if f.name not in present:
            if f.required:
                out.append(Rule(f"{dot}{f.name}.required", wrap(F.lit(True)), f"{dot}{f.name}: required"))
            continue
        value = get(f.name)
        if f.required:
            out.append(Rule(f"{dot}{f.name}.required", wrap(value.isNull()), f"{dot}{f.name}: required"))
        out += [
            Rule(name, wrap(F.coalesce(broken, F.lit(False))), message)
            for name, broken, message in _field_tests(f, value, f"{dot}{f.name}")
        ]
    for c in model.checks:
        if set(c.needs) <= present:
            out.append(Rule(f"{dot}{c.name}", wrap(F.coalesce(c.broken(get), F.lit(False))), c.message))
    for name, (inner, required) in model.blocks.items():
        inner_path = f"{dot}{name}"
        if name not in present:
            if required:
                out.append(Rule(f"{inner_path}.required", wrap(F.lit(True)), f"{inner_path}: required"))
            continue
        block = get(name)
        if required:
            out.append(Rule(f"{inner_path}.required", wrap(block.isNull()), f"{inner_path}: required"))
        data_type = schema[name].dataType
        inner_schema = _struct_of(data_type)
        if isinstance(data_type, T.ArrayType):
            rules = _array_rules(inner, inner_schema, block, inner_path, wrap)
        else:
            # fields of an absent optional block are not required
            def inside(test: Column, block=block) -> Column:
                return wrap(block.isNotNull() & test)

            rules = _rules(inner, inner_schema, lambda n, b=block: b[n], inner_path, inside)
        out += rules
    return out


def _array_rules(model: Model, schema: T.StructType, array: Column, path: str, wrap) -> list[Rule]:
    """Each rule of the element model, broken when any element breaks it."""
    def element_rules(x: Column) -> list[Rule]:
        return _rules(model, schema, lambda n: x.getField(n), path, lambda t: t)

    def nth(i: int) -> Callable[[Column], Column]:
        return lambda x: element_rules(x)[i].broken

    return [
        Rule(r.name, wrap(F.coalesce(F.exists(array, nth(i)), F.lit(False))), r.message)
        for i, r in enumerate(element_rules(F.struct(F.lit(None))))
    ]


def model_rules(model: Model, schema: T.StructType) -> list[Rule]:
    """All rules of a model for a table of the given schema; absent optional columns give none."""
    return _rules(model, schema, F.col, "", lambda t: t)


def _filled(model: Model, schema: T.StructType, get: Getter) -> dict[str, Column]:
    present = set(schema.fieldNames())
    filled: dict[str, Column] = {}

    def latest(name: str) -> Column:
        return filled.get(name, get(name))

    for target, (needs, value) in model.derive.items():
        if set(needs) <= present:
            made = value(latest)
            filled[target] = F.coalesce(get(target), made) if target in present else made
    for name, (inner, _) in model.blocks.items():
        inner_schema = _struct_of(schema[name].dataType) if name in present else None
        if inner_schema is None or isinstance(schema[name].dataType, T.ArrayType):
            continue
        block = get(name)
        nested = _filled(inner, inner_schema, lambda n, b=block: b[n])
        if nested:
            updated = block
            for n, c in nested.items():
                updated = updated.withField(n, c)
            filled[name] = F.when(block.isNotNull(), updated)
    return filled


def fill_derived(df: DataFrame, model: Model) -> DataFrame:
    """Fill missing values the model can compute from others."""
    return df.withColumns(_filled(model, df.schema, F.col))


def apply_rules(df: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Add ``errors`` (all messages) and ``is_valid``."""
    messages = F.array_compact(F.array(*[F.when(r.broken, F.lit(r.message)) for r in rules]))
    return df.withColumn("errors", messages).withColumn("is_valid", F.size("errors") == 0)


def validate(df: DataFrame, model: Model) -> DataFrame:
    """Judge the rows as they came, then fill what can be derived."""
    return fill_derived(apply_rules(df, model_rules(model, df.schema)), model)


def quarantine(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, invalid rows) of a validated table."""
    return validated.where("is_valid").drop("errors", "is_valid"), validated.where("not is_valid")


def violations(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Broken rows per rule, in one pass."""
    counts = df.agg(*[F.count_if(r.broken).alias(f"r{i}") for i, r in enumerate(rules)])
    rows = [F.struct(F.lit(r.name).alias("rule"), F.col(f"r{i}").alias("n_rows")) for i, r in enumerate(rules)]
    return counts.select(F.inline(F.array(*rows))).where("n_rows > 0")


def schema_mismatches(df: DataFrame, fields: Iterable[Field]) -> list[tuple[str, str, str]]:
    """(column, declared, found) where a table's type differs from the declared one."""
    found = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return [(f.name, f.kind, found[f.name]) for f in fields if f.kind and f.name in found and found[f.name] != f.kind]
