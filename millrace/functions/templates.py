"""Chat templates as column expressions.

A template in the usual notation ({% for %}, {% if %}, {% set %}, {{ }}) is compiled once, on the
driver, to one expression over an array of messages; no row of it runs in Python. Known
values (add_generation_prompt, bos_token and the like) are worked out while compiling.

Known are: for over messages, if, elif and else, set; strings, whole numbers, names, the fields role
and content of a message, places and slices of the messages, loop.index, index0, first and last;
+ and ~, comparisons, %, in, and, or, not, is defined, is none; the filters trim, length, upper, lower
and string; the methods strip, upper, lower and startswith; raise_exception. Anything else is a
ValueError when the template is compiled.

As in the usual rendering, the line end after a block and the blanks before it on its line go. A
null role or content is empty.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import strip

_TAG = re.compile(r"(\{%-?.*?-?%\}|\{\{-?.*?-?\}\}|\{#.*?#\})", re.S)
_STRINGS = re.compile(r"('(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")", re.S)
_CLOSING = {"for": "endfor", "if": "endif"}

Value = Column | str | int | bool | list | None


def _pieces(template: str) -> list[tuple[str, str]]:
    """("text" | "expr" | "block", content) in order, with the blanks about blocks settled."""
    parts = _TAG.split(template)
    out: list[tuple[str, str]] = []
    for k, part in enumerate(parts):
        if k % 2 == 0:
            begins = k == 0
            if k and not parts[k - 1].startswith("{{") and part.startswith("\n"):
                part, begins = part[1:], True
            if k + 1 < len(parts) and not parts[k + 1].startswith("{{"):
                line = re.search(r"(^|\n)[ \t]*\Z", part)
                if line and (line[1] or begins):
                    part = part[: line.start() + len(line[1])]
            if k and parts[k - 1][-3] == "-":
                part = part.lstrip()
            if k + 1 < len(parts) and parts[k + 1][2] == "-":
                part = part.rstrip()
            if part:
                out.append(("text", part))
        elif not part.startswith("{#"):
            out.append(("expr" if part.startswith("{{") else "block", part[2:-2].strip("-").strip()))
    return out


def _parsed(text: str) -> ast.expr:
    """An expression's tree. Filters bind closer than any sign here, so they stand as powers; ~ joins as +."""
    parts = _STRINGS.split(text)
    plain = [p if k % 2 else re.sub(r"\btrue\b", "True", re.sub(r"\bfalse\b", "False", re.sub(r"\bnone\b", "None", p))).replace("|", "**").replace("~", "+") for k, p in enumerate(parts)]
    try:
        return ast.parse("".join(plain).strip(), mode="eval").body
    except SyntaxError as e:
        raise ValueError(f"template expression {text!r}") from e


class _Tree:
    """Nodes of a template: ("text", s), ("expr", tree), ("set", name, tree), ("for", name, tree, body),
    ("if", [(tree or None, body)])."""

    def __init__(self, template: str):
        self.pieces, self.at = _pieces(template), 0
        self.nodes, end = self._body(())
        if end:
            raise ValueError(f"{end} without a beginning")

    def _body(self, until: tuple[str, ...]) -> tuple[list, str]:
        nodes: list = []
        while self.at < len(self.pieces):
            kind, content = self.pieces[self.at]
            self.at += 1
            if kind != "block":
                nodes.append((kind, content if kind == "text" else _parsed(content)))
                continue
            word, _, rest = content.partition(" ")
            if word in until:
                return nodes, content
            if word == "for":
                m = re.fullmatch(r"(\w+) in (.+)", rest.strip(), re.S)
                if not m:
                    raise ValueError(content)
                body, _ = self._body(("endfor",))
                nodes.append(("for", m[1], _parsed(m[2]), body))
            elif word == "if":
                branches, test = [], _parsed(rest)
                while True:
                    body, end = self._body(("elif", "else", "endif"))
                    branches.append((test, body))
                    if end == "endif":
                        break
                    test = _parsed(end.partition(" ")[2]) if end.startswith("elif") else None
                nodes.append(("if", branches))
            elif word == "set":
                name, _, value = rest.partition("=")
                nodes.append(("set", name.strip(), _parsed(value)))
            else:
                raise ValueError(f"{{% {content} %}}")
        if until:
            raise ValueError(f"no {until[-1]}")
        return nodes, ""


def _column(v: Value) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def _text(v: Value) -> Column | str:
    if isinstance(v, Column):
        return F.coalesce(v.cast("string"), F.lit(""))
    return "" if v is None else str(v)


def _joined(parts: list[Column | str]) -> Column | str:
    """Texts one after another; what is known stays a plain string."""
    out: list[Column | str] = []
    for p in parts:
        if isinstance(p, str) and out and isinstance(out[-1], str):
            out[-1] += p
        elif not (isinstance(p, str) and not p):
            out.append(p)
    if all(isinstance(p, str) for p in out):
        return "".join(out)
    return F.concat(*map(_column, out)) if len(out) > 1 else out[0]


class _Messages:
    """An array of messages, or of those from a place on."""

    def __init__(self, array: Column):
        self.array = array

    def size(self) -> Column:
        return F.size(self.array)


class _Compiler(ast.NodeVisitor):
    """The value of an expression: a known Python value or a column."""

    def __init__(self, names: dict[str, object]):
        self.names = names

    def generic_visit(self, node: ast.AST) -> Value:
        raise ValueError(f"a template cannot hold {ast.unparse(node)}")

    def visit_Constant(self, node: ast.Constant) -> Value:  # noqa: N802
        return node.value

    def visit_Name(self, node: ast.Name) -> Value:  # noqa: N802
        return self.names.get(node.id)

    def visit_Attribute(self, node: ast.Attribute) -> Value:  # noqa: N802
        owner = self.visit(node.value)
        if isinstance(owner, dict):
            return owner[node.attr]
        return owner[node.attr] if isinstance(owner, Column) else self.generic_visit(node)

    def visit_Subscript(self, node: ast.Subscript) -> Value:  # noqa: N802
        owner = self.visit(node.value)
        if isinstance(owner, _Messages):
            if isinstance(node.slice, ast.Slice):
                if node.slice.upper or node.slice.step or not node.slice.lower:
                    return self.generic_visit(node)
                first = self.visit(node.slice.lower)
                return _Messages(F.slice(owner.array, F.lit(first + 1), F.greatest(owner.size() - first, F.lit(0))))
            place = self.visit(node.slice)
            return F.get(owner.array, F.lit(place)) if place >= 0 else F.try_element_at(owner.array, F.lit(place))
        key = self.visit(node.slice)
        return owner[key] if isinstance(owner, Column) and isinstance(key, str) else self.generic_visit(node)

    def visit_BinOp(self, node: ast.BinOp) -> Value:  # noqa: N802
        if isinstance(node.op, ast.Pow):
            filters, rest = [], node.right
            while isinstance(rest, ast.BinOp) and isinstance(rest.op, ast.Pow):
                filters.append(rest.left)
                rest = rest.right
            value = self.visit(node.left)
            for f in [*filters, rest]:
                value = self._filtered(value, f.id if isinstance(f, ast.Name) else "")
            return value
        a, b = self.visit(node.left), self.visit(node.right)
        if isinstance(node.op, ast.Add):
            whole = isinstance(a, int) and isinstance(b, int)
            return a + b if whole else _joined([_text(a), _text(b)])
        if isinstance(node.op, ast.Mod):
            return a % b if not isinstance(a, Column) and not isinstance(b, Column) else _column(a) % _column(b)
        return self.generic_visit(node)

    def _filtered(self, value: Value, name: str) -> Value:
        if isinstance(value, _Messages):
            if name == "length":
                return value.size()
        elif name in ("trim", "upper", "lower", "string", "length"):
            return self._method(value, name)
        raise ValueError(f"a template cannot use the filter {name!r}")

    def _method(self, value: Value, name: str) -> Value:
        if not isinstance(value, Column):
            plain = "" if value is None else str(value)
            return {"trim": plain.strip, "upper": plain.upper, "lower": plain.lower, "string": plain.__str__, "length": plain.__len__}[name]()
        own = _text(value)
        return {"trim": lambda: strip(own), "upper": lambda: F.upper(own), "lower": lambda: F.lower(own), "string": lambda: own, "length": lambda: F.length(own)}[name]()

    def visit_Call(self, node: ast.Call) -> Value:  # noqa: N802
        args = [self.visit(a) for a in node.args]
        if isinstance(node.func, ast.Name) and node.func.id == "raise_exception":
            return F.raise_error(_column(args[0])).cast("string")
        if isinstance(node.func, ast.Attribute):
            owner, name = self.visit(node.func.value), node.func.attr
            if name in ("strip", "upper", "lower") and not args:
                return self._method(owner, "trim" if name == "strip" else name)
            if name == "startswith" and len(args) == 1:
                return owner.startswith(args[0]) if isinstance(owner, str) else F.startswith(_column(_text(owner)), _column(args[0]))
        return self.generic_visit(node)

    def visit_Compare(self, node: ast.Compare) -> Value:  # noqa: N802
        if len(node.ops) != 1:
            return self.generic_visit(node)
        op, right = node.ops[0], node.comparators[0]
        a = self.visit(node.left)
        if isinstance(op, (ast.Is, ast.IsNot)):
            plain = not isinstance(op, ast.IsNot)
            if isinstance(right, ast.Name) and right.id == "defined":
                found = a is not None
                return found if plain else not found
            none = a.isNull() if isinstance(a, Column) else a is None
            return none if plain else self._not(none)
        b = self.visit(right)
        if isinstance(op, (ast.In, ast.NotIn)):
            found = a in b if isinstance(a, str) and isinstance(b, (str, list)) else (_column(a).isin(b) if isinstance(b, list) else F.contains(_column(_text(b)), _column(_text(a))))
            return found if isinstance(op, ast.In) else self._not(found)
        known = not isinstance(a, Column) and not isinstance(b, Column)
        if isinstance(op, (ast.Eq, ast.NotEq)):
            same = a == b if known else _column(a).eqNullSafe(_column(b))
            return same if isinstance(op, ast.Eq) else self._not(same)
        x, y = (a, b) if known else (_column(a), _column(b))
        return {ast.Lt: lambda: x < y, ast.LtE: lambda: x <= y, ast.Gt: lambda: x > y, ast.GtE: lambda: x >= y}[type(op)]()

    def visit_List(self, node: ast.List) -> Value:  # noqa: N802
        return [self.visit(e) for e in node.elts]

    visit_Tuple = visit_List  # noqa: N815

    def truth(self, v: Value) -> Column | bool:
        if isinstance(v, _Messages):
            return v.size() > 0
        return v if isinstance(v, Column) else bool(v)

    def condition(self, node: ast.expr) -> Column | bool:
        """A test: a comparison as it is, a text by whether it is empty."""
        v = self.visit(node)
        if isinstance(v, Column) and isinstance(node, (ast.Name, ast.Attribute, ast.Subscript)) and not (isinstance(node, ast.Attribute) and node.attr in ("first", "last")):
            return F.coalesce(v.cast("string"), F.lit("")) != ""
        return self.truth(v)

    def _not(self, v: Column | bool) -> Column | bool:
        return ~v if isinstance(v, Column) else not v

    def visit_UnaryOp(self, node: ast.UnaryOp) -> Value:  # noqa: N802
        if isinstance(node.op, ast.USub):
            return -self.visit(node.operand)
        return self._not(self.condition(node.operand)) if isinstance(node.op, ast.Not) else self.generic_visit(node)

    def visit_BoolOp(self, node: ast.BoolOp) -> Value:  # noqa: N802
        every = isinstance(node.op, ast.And)
        out: Column | bool = every
        for v in map(self.condition, node.values):
            if isinstance(out, bool):
                out = v if out == every else out
            elif isinstance(v, bool):
                out = out if v == every else v
            else:
                out = out & v if every else out | v
        return out

    def visit_IfExp(self, node: ast.IfExp) -> Value:  # noqa: N802
        test = self.condition(node.test)
        if isinstance(test, bool):
            return self.visit(node.body if test else node.orelse)
        return F.when(test, _column(self.visit(node.body))).otherwise(_column(self.visit(node.orelse)))


def _rendered(nodes: list, names: dict[str, object]) -> Column | str:
    """The text of nodes; ``names`` gets what they set."""
    parts: list[Column | str] = []
    for node in nodes:
        c = _Compiler(names)
        if node[0] == "text":
            parts.append(node[1])
        elif node[0] == "expr":
            parts.append(_text(c.visit(node[1])))
        elif node[0] == "set":
            names[node[1]] = c.visit(node[2])
        elif node[0] == "for":
            parts.append(_looped(node, c, names))
        else:
            parts.append(_chosen(node[1], c, names))
    return _joined(parts)


def _looped(node: tuple, c: _Compiler, names: dict[str, object]) -> Column:
    items = c.visit(node[2])
    if not isinstance(items, _Messages):
        raise ValueError("a template loops over messages")

    def one(message: Column, i: Column) -> Column:
        loop = {"index0": i, "index": i + 1, "first": i == 0, "last": i == items.size() - 1, "length": items.size()}
        return _column(_rendered(node[3], {**names, node[1]: message, "loop": loop}))

    return F.array_join(F.transform(items.array, one), "")


def _chosen(branches: list, c: _Compiler, names: dict[str, object]) -> Column | str:
    """The branch that holds; what the branches set is chosen alike."""
    taken: list[tuple[Column | bool, Column | str, dict]] = []
    for test, body in branches:
        holds = True if test is None else c.condition(test)
        if holds is False:
            continue
        own = dict(names)
        taken.append((holds, _rendered(body, own), own))
        if holds is True:
            break
    if taken and taken[0][0] is True:
        names.update(taken[0][2])
        return taken[0][1]

    def pick(values: list, last: Callable[[], Column]) -> Column:
        known = values[-1] if taken[-1][0] is True else last()
        open_ = values[:-1] if taken[-1][0] is True else values
        return reduce(lambda rest, kv: F.when(kv[0], _column(kv[1])).otherwise(rest), reversed([(t[0], v) for t, v in zip(taken, open_, strict=False)]), _column(known))

    for name in {n for _, _, own in taken for n in own if own[n] is not names.get(n)}:
        before = names.get(name)
        values = [own.get(name) for _, _, own in taken]
        if any(isinstance(v, _Messages) for v in [*values, before]):
            names[name] = _Messages(pick([v.array for v in values], lambda b=before: b.array))
        else:
            names[name] = pick(values, lambda b=before: _column(b))
    return pick([text for _, text, _ in taken], lambda: F.lit("")) if taken else ""


def compile_template(template: str, messages: Column, **known: str | int | bool) -> Column:
    """The text of a template over an array of (role, content) messages, with known values."""
    return _column(_rendered(_Tree(template).nodes, {**known, "messages": _Messages(messages)}))


def chat_template(turns: DataFrame, keys: list[str], template: str, order: str = "turn", role: str = "role", content: str = "text", **known: str | int | bool) -> DataFrame:
    """(keys, prompt): each conversation by a template, its turns in order. A conversation is one prompt,
    so its turns have to meet in one row."""
    one = F.struct(F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(content).cast("string"), F.lit("")).alias("content"))
    gathered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), one.alias("m")))), lambda x: x["m"])
    return turns.groupBy(*keys).agg(gathered.alias("_messages")).select(*keys, compile_template(template, F.col("_messages"), **known).alias("prompt"))


def as_user(prompt: Column, template: str, **known: str | int | bool) -> Column:
    """A prompt as the only turn of a conversation, by a template."""
    message = F.struct(F.lit("user").alias("role"), F.coalesce(prompt, F.lit("")).alias("content"))
    return compile_template(template, F.array(message), **{"add_generation_prompt": True, **known})
