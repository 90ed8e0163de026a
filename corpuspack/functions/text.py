"""Scalar text and chat expressions (all native Spark expressions, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's ``str.isspace()`` accepts, in code point order.
# ``str.strip()`` removes exactly these; Spark's plain ``trim`` removes only U+0020.
WHITESPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u001c\u001d\u001e\u001f\u0020\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# ChatML markers, the default chat template.
CHAT_TEMPLATE = "<|im_start|>{role}\n{content}<|im_end|>\n"
GENERATION_PROMPT = "<|im_start|>assistant\n"

MESSAGES_TYPE = "array<struct<role:string,content:string>>"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: Column | str) -> Column:
    """Python ``str.strip()``: remove leading and trailing Unicode whitespace."""
    return F.btrim(_c(c), F.lit(WHITESPACE))


def null_to_empty(c: Column | str) -> Column:
    """``(x or "")`` for strings: null becomes ''."""
    return F.coalesce(_c(c), F.lit(""))


def clean(c: Column | str) -> Column:
    """``(x or "").strip()``."""
    return strip_ws(null_to_empty(c))


def first_truthy(*cols: Column | str) -> Column:
    """``a or b or ""``: null and '' fall through; a blank string does not."""
    return F.coalesce(*[F.nullif(_c(c), F.lit("")) for c in cols], F.lit(""))


def compose_prompt(instruction: Column | str, extra: Column | str) -> Column:
    """Instruction alone when ``extra`` is '', else instruction, a blank line, extra."""
    instruction, extra = _c(instruction), _c(extra)
    return F.when(extra == "", instruction).otherwise(F.concat(instruction, F.lit("\n\n"), extra))


def message(role: Column | str, content: Column | str) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), _c(content).cast("string").alias("content"))


def single_turn_chat(prompt: Column | str) -> Column:
    """``[{"role": "user", "content": prompt}]``."""
    return F.array(message("user", prompt))


def user_assistant_chat(user: Column | str, assistant: Column | str) -> Column:
    return F.array(message("user", user), message("assistant", assistant))


def render_chat(
    messages: Column | str,
    template: str = CHAT_TEMPLATE,
    add_generation_prompt: bool = False,
    generation_prompt: str = GENERATION_PROMPT,
) -> Column:
    """Messages → one prompt string. ``template`` holds ``{role}`` and ``{content}``. A null role or
    content counts as empty, so no message is lost."""
    before, rest = template.split("{role}", 1)
    middle, after = rest.split("{content}", 1)
    body = F.array_join(
        F.transform(
            _c(messages),
            lambda m: F.concat(F.lit(before), null_to_empty(m["role"]), F.lit(middle), null_to_empty(m["content"]), F.lit(after)),
        ),
        "",
    )
    if add_generation_prompt:
        body = F.concat(body, F.lit(generation_prompt))
    return body


def messages_json(messages: Column | str) -> Column:
    """JSON text of a message list, UTF-8 unescaped, field order role, content."""
    return F.to_json(_c(messages))
