"""Decisions about an import, put into the form that the plans take: rules under their usual names, mappings that read what
rules write, keys, types and headers that fit. Plain functions of configuration; no data is read here."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from ..functions import numbers
from ..functions.text import plain_name

# What the parts of a rule are also called; kinds of rules that are others by another name; delimiters in words.
ALIASES = {"source_column": ["column"], "target_column": ["target_field"], "outputs": ["targets"], "source_columns": ["sources", "columns"]}
KINDS = {"concat_columns": "merge_columns", "explode_list_values": "explode_list_column", "explode_list": "explode_list_rows"}
DELIMITERS = {"comma": ",", "default": ",", "": ",", "semicolon": ";", "semi-colon": ";", "pipe": "|", "tab": "\t", "\\t": "\t", "space": " "}
MAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
#: Columns that a directive splits into, if it doesn't say.
ITEMS = 5
# Parts of column rules, by kind.
COLUMN_PARTS = {
    "split_multi_value_column": ["source_column", "outputs"], "explode_list_column": ["source_column", "outputs"], "split_international_phone": ["source_column", "outputs"], "regex_replace": ["source_column"],
    "merge_columns": ["source_columns", "target_column"], "coalesce_columns": ["source_columns", "target_column"], "compose_international_phone": ["target_column"], "standardize_phone": ["source_column", "target_column"],
}


def part(rule: Mapping, name: str):
    """A part of a rule, by its name or another that it goes by."""
    return next((rule[n] for n in [name, *ALIASES.get(name, [])] if rule.get(n)), None)


def kind_of(rule: Mapping) -> str | None:
    """What a rule says it is, else what its parts show."""
    kind = rule.get("type") or rule.get("transform_type") or rule.get("action")
    if kind:
        return KINDS.get(kind, kind)
    if rule.get("components"):
        return "compose_international_phone"
    if rule.get("outputs"):
        return "split_multi_value_column" if "source_column" in rule else "split_international_phone" if rule.get("column") else None
    return None


def column_rules(rules: Sequence | None) -> list[dict]:
    """Column rules under their usual names; what is no rule goes."""
    out = []
    for rule in rules or []:
        kind = kind_of(rule) if isinstance(rule, Mapping) else None
        if not kind:
            continue
        found = {**rule, "type": kind} | {p: part(rule, p) for p in COLUMN_PARTS.get(kind, []) if part(rule, p)}
        if kind in ("merge_columns", "compose_international_phone"):
            found.setdefault("target_column", rule.get("target_field") or rule.get("column"))
        if kind == "regex_replace":
            found["target_column"] = rule.get("target_column") or rule.get("target_field") or found.get("source_column")
        out.append(found)
    return out


def explode_rule(rule: Mapping, kind: str) -> dict | None:
    many = kind == "explode_columns"
    source = part(rule, "source_columns") if many else part(rule, "source_column")
    target = rule.get("target_column") or rule.get("target_field") or rule.get("column")
    target = target or (None if many else source)
    if not source or not target:
        return None
    drop = "drop_source_columns" if many else "drop_source_column"
    given = {"source_columns": list(source)} if many else {"source_column": source, "delimiter": rule.get("delimiter")}
    flags = {"include_original_row": False, "keep_empty_rows": False, "dedupe_values": True, "case_insensitive_dedupe": True, "strip_whitespace": True}
    return {"type": kind, **given, "target_column": target, "drop_source_columns": rule.get(drop, rule.get("drop_source_columns", True)), **{f: rule.get(f, v) for f, v in flags.items()}}


def filter_rule(rule: Mapping, kind: str) -> dict | None:
    """A filter without a pattern looks for addresses in columns of mail, for anything in others."""
    columns = rule.get("columns") or rule.get("source_columns")
    include, exclude = rule.get("include_regex"), rule.get("exclude_regex")
    if not include and not exclude:
        if not columns:
            return None
        include = MAIL if any("mail" in str(c).lower() for c in columns) else ".+"
    return {"type": kind, "include_regex": include, "exclude_regex": exclude, "columns": columns}


def replace_rule(rule: Mapping, kind: str) -> dict | None:
    columns = rule.get("columns") or rule.get("source_columns") or rule.get("target_columns")
    return {"type": kind, "pattern": rule["pattern"], "replacement": rule.get("replacement", ""), "columns": columns} if rule.get("pattern") and columns else None


def conditional_rule(rule: Mapping, kind: str) -> dict:
    when = {k: rule.get(k) for k in ("include_regex", "exclude_regex")} | {"columns": rule.get("columns") or rule.get("source_columns")}
    return {"type": kind, **when, "actions": row_rules(rule.get("actions") or rule.get("transformations"))}


def joining_rule(rule: Mapping, kind: str) -> dict | None:
    sources, target = part(rule, "source_columns"), rule.get("target_column") or rule.get("target_field") or rule.get("column")
    return {"type": "concat_columns", "source_columns": sources, "target_column": target, "separator": rule.get("separator", " "), "null_replacement": rule.get("null_replacement")} if sources and target else None


def any_of_rule(rule: Mapping, kind: str) -> dict | None:
    columns = rule.get("columns") or rule.get("source_columns")
    return {"type": kind, "columns": columns} if columns else None


ROW_FORMS = {"explode_columns": explode_rule, "explode_list_rows": explode_rule, "filter_rows": filter_rule, "regex_replace": replace_rule, "conditional_transform": conditional_rule, "merge_columns": joining_rule, "require_any_of": any_of_rule}


def row_rules(rules: Sequence | None) -> list[dict]:
    """Row rules under their usual names; what is malformed goes, kinds that are not known stay as they are."""
    out = []
    for rule in rules or []:
        kind = (rule.get("type") or rule.get("action")) if isinstance(rule, Mapping) else None
        kind = KINDS.get(kind, kind)
        if kind in ROW_FORMS:
            out += [r for r in [ROW_FORMS[kind](rule, kind)] if r]
        elif kind:
            out.append(dict(rule))
    return out


def delimiter(word: str | None) -> str:
    return "," if not word else DELIMITERS.get(word.strip().lower(), word)


def with_directives(directives: Sequence | None, columns: Sequence[str], mapping: Mapping[str, str], column_rules_: Sequence[Mapping], row_rules_: Sequence[Mapping]) -> tuple[dict, list, list]:
    """Mapping (source -> target) and rules with what directives about columns of several values ask for: the values go into
    columns of their own, these into rows, and the target is read from there. Directives about columns that aren't there go."""
    mapping, split, explode = dict(mapping), list(column_rules_), list(row_rules_)
    for d in directives or []:
        source = d.get("source_column") if isinstance(d, Mapping) else None
        if not source or source not in columns:
            continue
        target = d.get("target_column") or mapping.get(source) or source
        outputs = [str(o) for o in d.get("outputs") or [] if o] or [f"{source}_item_{i + 1}" for i in range(int(d.get("max_items") or ITEMS))]
        split.append({"type": "split_multi_value_column", "source_column": source, "delimiter": delimiter(d.get("delimiter")), "outputs": [{"name": o, "index": i} for i, o in enumerate(outputs)]})
        explode.append(explode_rule({"source_columns": outputs, "target_column": target}, "explode_columns"))
        mapping = {s: t for s, t in mapping.items() if t not in (target, source)} | {target: target}
    return mapping, split, explode


# Phrases that ask for the first of several columns only, the words for each kind of contact, and words of columns that
# aren't the first.
KEEP_ONE = ["keep only", "only keep", "primary only", "single", "one per", "first only"]
KINDS_OF_CONTACT = {"email": ["email", "e-mail", "mail"], "phone": ["phone", "telephone", "tel", "mobile", "contact number"]}
IN_NAMES = {"email": ["email", "mail"], "phone": ["phone", "mobile", "tel", "cell"]}
LATER = ["secondary", "alternate", "alternative", "additional", "other", "backup", "alt"]


def primary_only(instruction: str, mapping: Mapping[str, str], row_rules_: Sequence[Mapping]) -> tuple[dict, list]:
    """If an instruction asks for primary addresses or numbers only: mapping and rules without the columns of others.

    Of the columns of a kind that the instruction names (none, if it names none), the one called primary stays, else the first that isn't
    called secondary or numbered from 2 on; explodes lose the columns that went, and go with the last of them."""
    text = (instruction or "").lower()
    named = [k for k, words in KINDS_OF_CONTACT.items() if any(w in text for w in words)]
    if not named or not any(p in text for p in KEEP_ONE):
        return dict(mapping), list(row_rules_)
    gone: set[str] = set()
    for kind in named:
        of_kind = [s for s in mapping if any(w in plain_name(s) for w in IN_NAMES[kind])]
        later = [s for s in of_kind if any(w in plain_name(s) for w in LATER) or re.search(r"[2-9]$", plain_name(s))]
        first = [s for s in of_kind if "primary" in plain_name(s)] or [s for s in of_kind if s not in later] or of_kind
        gone |= set(of_kind) - set(first[:1])
    rules = []
    for r in row_rules_:
        if str(r.get("type")).startswith("explode"):
            sources = list(r.get("source_columns") or [r.get("source_column")])
            left = [s for s in sources if s not in gone]
            if not left or len(sources) > 1 and len(left) == 1 and left[0] in mapping:
                continue
            r = {**r, "source_columns": left} if "source_columns" in r else dict(r)
        rules.append(r)
    return {s: t for s, t in mapping.items() if s not in gone}, rules


def reading_rules(mapping: Mapping[str, str], rules: Sequence[Mapping]) -> dict[str, str]:
    """A mapping (target -> source) that reads what column rules write: a phone that is standardized into its target is read from
    there, and the target of a coalesce is a column."""
    out = dict(mapping)
    for r in rules:
        source = part(r, "source_column")
        target = r.get("target_column") or r.get("target_field") or (r.get("column") if r.get("type") == "coalesce_columns" else source)
        if r.get("type") == "standardize_phone" and target in out and out[target] == source:
            out[target] = target
        elif r.get("type") == "coalesce_columns" and target:
            out.setdefault(target, target)
    return out


def holds(existing: str, desired: str) -> bool:
    """Whether a column of one type takes values of another as it is."""
    have, want = existing.upper(), desired.upper()
    return have == want or have == "TEXT" or want == "BOOLEAN" and numbers.family(have) in ("integer", "decimal")


def alignments(existing: Mapping[str, str], desired: Mapping[str, str], targeted: Sequence[str] = ()) -> list[dict]:
    """Migrations for columns whose type can't hold what is wanted; those that are migrated anyway stay out."""
    return [{"action": "replace_column", "column": c, "type": t} for c, t in desired.items() if t and existing.get(c) and c not in targeted and not holds(existing[c], t)]


def placeholder_columns(columns: Sequence[str]) -> bool:
    shown = [c for c in columns if not c.startswith("_")]
    return bool(shown) and all(re.fullmatch(r"col_\d+", c) for c in shown)


def header_repair(columns: Sequence[str], mapping: Mapping[str, str]) -> bool:
    """Whether a file should be read again with a header: its columns are numbered, but the mapping (target -> source) names some."""
    named = [s for s in mapping.values() if not re.fullmatch(r"col_\d+", str(s))]
    return placeholder_columns(columns) and bool(named)


def reconciled_rows(parsed: int, scanned: int, mapping: Mapping[str, str], other_columns: Sequence[str], other_rows: int) -> tuple[bool, str | None]:
    """Whether to take the reading with the opposite header instead, and a warning. It is taken if the counts differ, its own
    count is right, and it has all columns that the mapping reads."""
    if parsed == scanned:
        return False, None
    if other_rows == scanned and set(mapping.values()) <= set(other_columns):
        return True, None
    return False, f"{parsed} rows were parsed, {scanned} were counted in the file"


# Words that ask for data (anywhere in a question), and words that ask for advice instead.
ASKS = [
    "top", "best", "worst", "total", "sum", "average", "avg", "count", "revenue", "spend", "list", "show", "highest", "lowest", "report", "breakdown", "rank", "ranking", "per", "by ", " vs ", "compare", "distribution", "growth", "trend",
    "increase", "decrease", "customers", "advertisers", "campaign", "merge", "combine", "union", "records from", "rows from",
]
ADVICE = ["idea", "strategy", "suggest"]


def wants_sql(prompt: str) -> bool:
    """Whether a question is one about data."""
    text = prompt.lower()
    return any(w in text for w in ASKS) and not any(w in text for w in ADVICE)


def reply_parts(reply: str) -> dict:
    """sql, explanation and tables of a model's reply: fenced SQL (else the first statement), what follows EXPLANATION: and
    TABLES:, else the tables that the SQL names."""
    fenced = re.search(r"```(?:sql)?\s*(.*?)```", reply, re.S | re.I)
    bare = re.search(r"(?is)\b(?:SELECT|WITH)\b.*?(?=;|\n\s*\n|\n\s*(?:EXPLANATION|TABLES)\b|$)", reply)
    sql = (fenced[1] if fenced else bare[0] if bare else "").strip().rstrip(";").strip()
    told = re.search(r"(?is)EXPLANATION:\s*(.*?)(?=\n\s*TABLES(?:_USED)?:|```|$)", reply)
    listed = re.search(r"(?im)^\s*TABLES(?:_USED)?:\s*(.+)$", reply)
    names = re.split(r"[,\s]+", listed[1].strip().strip("[]")) if listed else re.findall(r"(?i)\b(?:FROM|JOIN)\s+[`\"]?([\w.]+)", sql)
    return {"sql": sql, "explanation": told[1].strip() if told else "", "tables": list(dict.fromkeys(n.strip("`\"'") for n in names if n.strip("`\"'")))}
