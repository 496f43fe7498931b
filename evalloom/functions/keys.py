"""Stable content-derived keys and small text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Model ids that stand for another checkpoint.
ALIASES: dict[str, str] = {"qwen3-8b:low": "deepseek-ai/DeepSeek-R1-0528-Qwen3-8B"}


def compact_json(*parts: Column) -> Column:
    """A JSON array of strings without spaces, non-ASCII kept; a null part is ``null``."""
    quoted = [F.coalesce(F.regexp_replace(_lower_escapes(F.to_json(F.array(p)), p), r"(?s)^\[(.*)\]$", "$1"), F.lit("null")) for p in parts]
    return F.concat(F.lit("["), F.concat_ws(",", *quoted), F.lit("]"))


def _lower_escapes(text: Column, source: Column) -> Column:
    """Control characters escaped with small letters, as in ``\\u000b``."""
    out = text
    for code in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)):
        out = F.regexp_replace(out, rf"(?<!\\)((?:\\\\)*)\\u{code:04X}", rf"$1\\u{code:04x}")
    return F.when(source.rlike(r"[\x0B\x0E\x0F\x1A-\x1F]"), out).otherwise(text)


def case_id(model: Column, dataset: Column, problem: Column, permutation: Column) -> Column:
    """``case-`` and 24 hex digits of the SHA-256 of ``[model,dataset,problem,[permutation...]]``."""
    body = compact_json(model, dataset, problem)
    whole = F.concat(F.expr("''"), F.regexp_replace(body, r"\]$", ","), F.to_json(permutation), F.lit("]"))
    return F.concat(F.lit("case-"), F.substring(F.sha2(whole, 256), 1, 24))


def family_id(dataset: Column, problem: Column) -> Column:
    """``f`` and 12 hex digits of the SHA-256 of ``[dataset,problem]``."""
    return F.concat(F.lit("f"), F.substring(F.sha2(compact_json(dataset, problem), 256), 1, 12))


def prompt_key(text: Column) -> Column:
    return F.sha2(text, 256)


def canonical_json(**fields: Column) -> Column:
    """A JSON object with sorted keys, no spaces and explicit nulls."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def safe_model_id(model: Column) -> Column:
    """Runs outside ``[A-Za-z0-9._-]`` become ``_``; outer ``_`` go."""
    return F.regexp_replace(F.regexp_replace(model, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")


def resolve_alias(model: Column, aliases: dict[str, str] | None = None) -> Column:
    aliases = ALIASES if aliases is None else aliases
    if not aliases:
        return model
    pairs = F.create_map(*[F.lit(x) for kv in sorted(aliases.items()) for x in kv])
    return F.coalesce(F.try_element_at(pairs, model), model)


def stripped(text: Column) -> Column:
    """Without white space at either end, Unicode spaces included."""
    space = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}]+"
    return F.regexp_replace(F.regexp_replace(text, f"^{space}", ""), f"{space}$", "")


def numbered(prefix: str, n: Column, width: int = 2) -> Column:
    """``v01``, ``batch-01``: a prefix and a zero-padded number."""
    return F.format_string(f"{prefix}%0{width}d", n)


def chat_prompt(user: Column, system: Column | None = None, template: str | None = None) -> Column:
    """A prompt: by ``template`` with its places {system} and {user}, where there is a system text; else that
    text, if any, a blank line and the user's."""
    if template is not None and system is not None:
        marked = F.replace(F.replace(F.lit(template), F.lit("{system}"), system), F.lit("{user}"), user)
        return F.when(system.isNull() | (system == ""), user).otherwise(marked)
    return user if system is None else F.when(system.isNull() | (system == ""), user).otherwise(F.concat(system, F.lit("\n\n"), user))


def numeric(x: Column) -> Column:
    """A double, or null where the value isn't one."""
    return x.try_cast("double")


def id_union(*ids: Column) -> Column:
    """The distinct ids of scalar and array columns, sorted; null counts as none."""
    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.array(*ids)), lambda x: x.isNotNull())))


def id_set(value) -> list[int]:
    """The ids of a scalar, a sequence or None, sorted."""
    if value is None:
        return []
    if isinstance(value, bool):
        raise TypeError("a boolean is no id")
    return [value] if isinstance(value, int) else sorted(set(value))
