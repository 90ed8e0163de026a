"""B12 with templates as data: a tokenizer's own chat template becomes one Column expression.

Chat templates are published as text with loops and conditions. ``compile_template`` takes such a text and gives a
function from a ``messages`` column to the rendered string, so that rendering stays inside Spark's generated code. It
knows what the published shapes are made of: one level of ``for`` over ``messages`` (or a slice of it), ``if`` /
``elif`` / ``else``, ``set``, text and ``{{ … }}``; in expressions string and number literals, ``message['role']`` or
``message.content``, ``messages[0]['role']``, ``loop.first``, ``loop.last``, ``loop.index0``, ``+`` or ``~``,
comparisons, ``and`` / ``or`` / ``not``, ``in``, ``| trim``, ``messages | length``, ``add_generation_prompt``,
``bos_token`` and ``eos_token``. Anything else is refused by name.

White space follows the usual settings for chat templates: a line that holds only a tag leaves nothing, the line end
behind a tag is dropped, and ``-`` inside a tag's edge takes all white space on that side. A null role or content
counts as empty.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuspack.functions.text import null_to_empty, strip_ws

_TAG = re.compile(r"\{%-?.*?-?%\}|\{\{-?.*?-?\}\}|\{#.*?#\}", re.S)

# Published chat templates.
CHATML_DEFAULT_SYSTEM = (
    "{% for message in messages %}{% if loop.first and messages[0]['role'] != 'system' %}"
    "{{ '<|im_start|>system\\nYou are a helpful assistant.<|im_end|>\\n' }}{% endif %}"
    "{{'<|im_start|>' + message['role'] + '\\n' + message['content'] + '<|im_end|>' + '\\n'}}{% endfor %}"
    "{% if add_generation_prompt %}{{ '<|im_start|>assistant\\n' }}{% endif %}"
)
ROLE_TAGS = (
    "{% for message in messages %}\n{% if message['role'] == 'user' %}\n{{ '<|user|>\\n' + message['content'] + eos_token }}\n"
    "{% elif message['role'] == 'system' %}\n{{ '<|system|>\\n' + message['content'] + eos_token }}\n"
    "{% elif message['role'] == 'assistant' %}\n{{ '<|assistant|>\\n'  + message['content'] + eos_token }}\n{% endif %}\n"
    "{% if loop.last and add_generation_prompt %}\n{{ '<|assistant|>' }}\n{% endif %}\n{% endfor %}"
)
HEADER_IDS = (
    "{% set loop_messages = messages %}{% for message in loop_messages %}"
    "{% set content = '<|start_header_id|>' + message['role'] + '<|end_header_id|>\\n\\n'+ message['content'] | trim + '<|eot_id|>' %}"
    "{% if loop.index0 == 0 %}{% set content = bos_token + content %}{% endif %}{{ content }}{% endfor %}"
    "{% if add_generation_prompt %}{{ '<|start_header_id|>assistant<|end_header_id|>\\n\\n' }}{% endif %}"
)


def _parts(template: str) -> list[tuple[str, str]]:
    """``(kind, content)`` pieces: text, expressions (``out``) and statements (``tag``), white space settled."""
    out: list[list[str]] = []
    at, cut_left, drop_line = 0, False, False
    for m in [*_TAG.finditer(template), None]:
        text = template[at : m.start() if m else len(template)]
        if cut_left:
            text = text.lstrip()
        elif drop_line and text.startswith("\n"):
            text = text[1:]
        if "{{" in text or "{%" in text:
            raise ValueError("a tag is not closed")
        if m is None:
            out.append(["text", text])
            break
        tag = m[0]
        if tag[2] == "-":
            text = text.rstrip()
        elif not tag.startswith("{{"):  # white space between a line's start and a statement
            before = text.rstrip(" \t")
            if before.endswith("\n") or (not before and (at == 0 or drop_line)):
                text = before
        out.append(["text", text])
        if not tag.startswith("{#"):
            out.append(["out" if tag.startswith("{{") else "tag", tag[2:-2].strip("-").strip()])
        cut_left, drop_line, at = tag[-3] == "-", not tag.startswith("{{"), m.end()
    return [(k, c) for k, c in out if c]


def _block(parts: list[tuple[str, str]], at: int, ends: tuple[str, ...]) -> tuple[list, int]:
    """Statements up to one of ``ends``: nested lists ``("for", name, source, body)`` and ``("if", [(test, body)])``."""
    body: list = []
    while at < len(parts):
        kind, content = parts[at]
        word = content.split(None, 1)[0] if kind == "tag" else ""
        if word in ends:
            return body, at
        if kind != "tag":
            body.append((kind, content))
        elif word == "set":
            name, _, value = content[3:].partition("=")
            body.append(("set", name.strip(), value))
        elif word == "for":
            found = re.fullmatch(r"for\s+(\w+)\s+in\s+(.+)", content, re.S)
            if not found:
                raise ValueError(f"this loop is not supported: {content}")
            inner, at = _block(parts, at + 1, ("endfor",))
            body.append(("for", found[1], found[2], inner))
        elif word == "if":
            cases, test = [], content[2:]
            while test is not None:
                inner, at = _block(parts, at + 1, ("elif", "else", "endif"))
                if at >= len(parts):
                    raise ValueError("an if without its endif")
                cases.append((test, inner))
                head = parts[at][1].split(None, 1)
                test = {"elif": head[-1], "else": "True"}.get(head[0])
            body.append(("if", cases))
        else:
            raise ValueError(f"this statement is not supported: {content}")
        at += 1
    if ends:
        raise ValueError(f"{' or '.join(ends)} is missing")
    return body, at


class _Messages:
    """A message list, or a slice of it from ``first`` on."""

    def __init__(self, column: Column, first: int = 0):
        self.column, self.first = column, first

    def rest(self) -> Column:
        n = F.size(self.column) - self.first
        return self.column if not self.first else F.slice(self.column, self.first + 1, F.greatest(n, F.lit(0)))


class _Message:
    def __init__(self, column: Column):
        self.column = column

    def field(self, name: str) -> Column:
        if name not in ("role", "content"):
            raise ValueError(f"messages have no field {name!r}")
        return null_to_empty(self.column[name])


def _value(node, env: Mapping):
    """An expression as a Column, a Python constant, a message or a message list."""
    see = lambda n: _value(n, env)
    if isinstance(node, ast.Constant) and (node.value is None or isinstance(node.value, (str, int, bool))):
        return node.value
    if isinstance(node, ast.Name):
        if node.id not in env:
            raise ValueError(f"{node.id} is not supported")
        return env[node.id]
    if isinstance(node, ast.Attribute):
        if node.attr == "trim":
            return strip_ws(_column(see(node.value)))
        base = see(node.value)
        if node.attr == "length" and isinstance(base, _Messages):
            return F.size(base.rest())
        if isinstance(base, _Message):
            return base.field(node.attr)
        if isinstance(base, dict) and node.attr in base:
            return base[node.attr]
    if isinstance(node, ast.Subscript):
        base = see(node.value)
        if isinstance(base, _Message):
            return base.field(see(node.slice))
        if isinstance(base, _Messages) and isinstance(node.slice, ast.Slice) and node.slice.upper is None and node.slice.step is None:
            return _Messages(base.column, base.first + see(node.slice.lower))
        if isinstance(base, _Messages) and isinstance(index := see(node.slice), int):
            return _Message(F.get(base.column, F.lit(base.first + index)) if index >= 0 else F.try_element_at(base.column, F.lit(index)))
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
        return F.concat(_column(see(node.left)), _column(see(node.right)))
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Mod):
        return see(node.left) % see(node.right)
    if isinstance(node, ast.BoolOp):
        out = _test(see(node.values[0]))
        for v in node.values[1:]:
            out = out & _test(see(v)) if isinstance(node.op, ast.And) else out | _test(see(v))
        return out
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
        return ~_test(see(node.operand))
    if isinstance(node, ast.Compare) and len(node.ops) == 1:
        a, b, op = see(node.left), node.comparators[0], node.ops[0]
        if isinstance(op, (ast.In, ast.NotIn)) and isinstance(b, (ast.List, ast.Tuple)):
            found = _column(a).isin([see(e) for e in b.elts])
            return found if isinstance(op, ast.In) else ~found
        if isinstance(op, (ast.Eq, ast.NotEq, ast.Lt, ast.Gt)):
            a, b = _column(a), _column(see(b))
            return {ast.Eq: a == b, ast.NotEq: a != b, ast.Lt: a < b, ast.Gt: a > b}[type(op)]
    raise ValueError(f"this expression is not supported: {ast.unparse(node)}")


def _column(value) -> Column:
    if isinstance(value, (_Message, _Messages, dict)):
        raise ValueError("a message is not a text")
    return value if isinstance(value, Column) else F.lit(value)


def _test(value) -> Column:
    if isinstance(value, str):
        return F.lit(bool(value))
    return F.coalesce(_column(value).cast("boolean"), F.lit(False))


def _read(text: str, env: Mapping):
    source = re.sub(r"\|\s*(trim|length)\b", r".\1", text).replace("~", "+").strip()
    source = re.sub(r"\b(true|false|none)\b", lambda m: m[1].title(), source)
    try:
        tree = ast.parse(source, mode="eval")
    except SyntaxError as e:
        raise ValueError(f"this expression is not supported: {text}") from e
    return _value(tree.body, env)


def _render(body: list, env: dict) -> list[Column]:
    """The pieces that ``body`` writes; ``set`` changes ``env``."""
    out: list[Column] = []
    for step in body:
        if step[0] == "text":
            out.append(F.lit(step[1]))
        elif step[0] == "out":
            out.append(_column(_read(step[1], env)).cast("string"))
        elif step[0] == "set":
            env[step[1]] = _read(step[2], env)
        elif step[0] == "for":
            source = _read(step[2], env)
            if not isinstance(source, _Messages) or "loop" in env:
                raise ValueError("only one loop over the messages is supported")
            out.append(F.array_join(F.transform(source.rest(), _turn(step, env, F.size(source.rest()))), ""))
        else:
            tests = [_test(_read(t, env)) for t, _ in step[1]]
            branches = [dict(env) for _ in tests]
            texts = [_joined(_render(inner, own)) for (_, inner), own in zip(step[1], branches)]
            out.append(_choice(tests, texts, F.lit("")))
            for name in {n for own in branches for n in own if own[n] is not env.get(n)}:
                if any(isinstance(own.get(name), (_Message, _Messages)) for own in branches):
                    raise ValueError(f"{name} depends on a condition")
                env[name] = _choice(tests, [_column(own.get(name, "")) for own in branches], _column(env.get(name, "")))
    return out


def _turn(step: tuple, env: dict, n: Column):
    """What one pass of a loop over ``n`` messages writes."""

    def one(message, i):
        loop = {"first": i == 0, "last": i == n - 1, "index0": i, "index": i + 1}
        return _joined(_render(step[3], {**env, step[1]: _Message(message), "loop": loop}))

    return one


def _choice(tests: list[Column], values: list[Column], otherwise: Column) -> Column:
    out = otherwise
    for test, value in reversed(list(zip(tests, values))):
        out = F.when(test, value).otherwise(out)
    return out


def _joined(pieces: list[Column]) -> Column:
    return F.concat(*pieces) if pieces else F.lit("")


def compile_template(template: str, bos_token: str = "", eos_token: str = "") -> Callable[..., Column]:
    """``render(messages, add_generation_prompt=False)``: the text of a chat by a published template."""
    body, _ = _block(_parts(template), 0, ())

    def render(messages: Column | str, add_generation_prompt: bool = False) -> Column:
        column = F.col(messages) if isinstance(messages, str) else messages
        env = {"messages": _Messages(column), "add_generation_prompt": add_generation_prompt, "bos_token": bos_token, "eos_token": eos_token}
        return _joined(_render(body, env))

    render("messages")  # what is not supported is refused now
    return render
