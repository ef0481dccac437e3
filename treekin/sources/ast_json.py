"""Trees as JSON: nested objects with label, value (if any) and children (if any)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

Row = tuple[str, str | None, int, int]


def tree_to_json(ast: list[Row]) -> str:
    """ast: (label, value, depth, n_children) in preorder."""
    out: list[str] = []
    open_: list[int] = []  # children left of the nodes that are open
    for label, value, _, n in ast:
        if out and out[-1] not in ("[",):
            out.append(", ")
        node = f'{{"label": {json.dumps(label, ensure_ascii=False)}' + (f', "value": {json.dumps(value, ensure_ascii=False)}' if value is not None else "")
        if n:
            out += [node + ', "children": ', "["]
            open_.append(n)
            continue
        out.append(node + "}")
        while open_:
            open_[-1] -= 1
            if open_[-1]:
                break
            open_.pop()
            out.append("]}")
    return "".join(out)


def tree_from_json(text: str) -> list[Row]:
    out, todo = [], [(json.loads(text), 0)]
    while todo:
        node, depth = todo.pop()
        children = node.get("children") or []
        out.append((node["label"], node.get("value"), depth, len(children)))
        todo.extend((c, depth + 1) for c in reversed(children))
    return out


@F.pandas_udf(StringType())
def ast_to_json(ast: pd.Series) -> pd.Series:
    """Of a column of flat trees."""
    return ast.map(lambda t: None if t is None else tree_to_json([(x["label"], x["value"], x["depth"], x["n_children"]) for x in t]))


def ast_from_json(column):
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    kind = ArrayType(StructType([StructField("label", StringType()), StructField("value", StringType()), StructField("depth", IntegerType()), StructField("n_children", IntegerType())]))
    read = F.udf(lambda text: None if text is None else tree_from_json(text), kind, useArrow=True)
    return read(column)
