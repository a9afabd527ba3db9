"""Named tables with their mappings: aliases, patterns over several tables, generations, introspection."""

from __future__ import annotations

import fnmatch
import re
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchloom.plans import dates
from searchloom.plans.query import QueryError, compile_query


@dataclass
class Mapping:
    """Types and options of fields beyond the table's schema."""

    text: list[str] = field(default_factory=list)
    analyzers: dict[str, str] = field(default_factory=dict)
    geo: dict[str, tuple[str, str]] = field(default_factory=dict)
    mode: str = "dynamic"

    def options(self) -> dict:
        return {"text_fields": self.text, "analyzers": self.analyzers, "geo": self.geo}


@dataclass
class Catalog:
    tables: dict[str, DataFrame] = field(default_factory=dict)
    mappings: dict[str, Mapping] = field(default_factory=dict)
    aliases: dict[str, list[str]] = field(default_factory=dict)
    created: dict[str, datetime] = field(default_factory=dict)
    states: dict[str, list] = field(default_factory=dict)
    read_only: set[str] = field(default_factory=set)

    def add(self, name: str, df: DataFrame, mapping: Mapping | None = None, created: datetime | None = None) -> None:
        if not re.fullmatch(r"[a-z0-9][a-z0-9._+-]*", name) or len(name) > 255:
            raise ValueError(f"not a table name: {name!r}")
        self.tables[name], self.mappings[name] = df, mapping or Mapping()
        if created is not None:
            self.created[name] = created

    def names(self, pattern: str) -> list[str]:
        """Tables of a comma-separated list of names, aliases and patterns."""
        out: list[str] = []
        for p in pattern.split(","):
            if p.startswith("-"):
                out = [n for n in out if not fnmatch.fnmatchcase(n, p[1:])]
                continue
            hit = [p] if p in self.tables else self.aliases.get(p) or sorted(n for n in self.tables if fnmatch.fnmatchcase(n, "*" if p == "_all" else p))
            if not hit and "*" not in p:
                raise KeyError(f"no table {p}")
            out += [n for n in hit if n not in out]
        return out

    def scan(self, pattern: str) -> DataFrame:
        """All rows of the tables with ``_index``; fields that a table lacks are null."""
        out = None
        for n in self.names(pattern):
            df = self.tables[n].withColumn("_index", F.lit(n))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        if out is None:
            raise KeyError(f"no table matches {pattern}")
        return out

    def rollover(self, alias: str) -> str:
        """A new generation behind an alias, empty, with the newest one's schema."""
        old = self.aliases[alias][-1]
        m = re.fullmatch(r"(.*?)-(\d{6})", old)
        new = f"{m[1]}-{int(m[2]) + 1:06d}" if m else f"{old}-000002"
        self.add(new, self.tables[old].limit(0), self.mappings[old])
        self.aliases[alias].append(new)
        return new

    def rollover_if(self, alias: str, conditions: dict, now: datetime) -> dict[str, bool]:
        """Whether each condition (``max_docs``, ``max_age`` such as ``7d``) holds for the newest generation; it is rolled over if one does."""
        name = self.aliases[alias][-1]
        met = {}
        for kind, limit in conditions.items():
            if kind == "max_docs":
                met[kind] = self.tables[name].limit(int(limit)).count() >= int(limit)
            elif kind == "max_age":
                met[kind] = (now - self.created[name]).total_seconds() * 1000 >= dates.interval_ms(limit)
            else:
                raise ValueError(f"unknown condition {kind}")
        if any(met.values()):
            self.created[self.rollover(alias)] = now
        return met

    def apply_policy(self, alias: str, policy: dict, now: datetime) -> list[tuple[str, str, str]]:
        """One tick of a lifecycle policy over the generations behind an alias; (table, state, action) for each action taken.

        ``policy`` has ``default_state`` and ``states``: each with ``actions`` (``rollover`` with conditions, ``read_only``, ``delete``) and
        ``transitions`` (``state_name``, ``conditions`` with ``min_index_age`` or ``min_doc_count``). A table's actions are taken once per
        state; its first transition that holds is followed, so a table moves by one state in a tick.
        """
        states = {s["name"]: s for s in policy["states"]}
        done = []
        for name in list(self.aliases[alias]):
            at = self.states.setdefault(name, [policy["default_state"], False])
            state = states[at[0]]
            if not at[1]:
                for action in state.get("actions", []):
                    (kind, p), = action.items()
                    if kind == "rollover":
                        if name != self.aliases[alias][-1] or not any(self.rollover_if(alias, p or {}, now).values()):
                            continue
                    elif kind == "read_only":
                        self.read_only.add(name)
                    elif kind == "delete":
                        self.drop(name)
                    else:
                        raise ValueError(f"unknown action {kind}")
                    done.append((name, at[0], kind))
                at[1] = all(next(iter(a)) != "rollover" for a in state.get("actions", [])) or name != self.aliases[alias][-1]
            if name not in self.tables:
                continue
            for t in state.get("transitions", []):
                c = t.get("conditions", {})
                old = "min_index_age" not in c or (now - self.created.get(name, now)).total_seconds() * 1000 >= dates.interval_ms(c["min_index_age"])
                many = "min_doc_count" not in c or self.tables[name].limit(int(c["min_doc_count"])).count() >= int(c["min_doc_count"])
                if old and many:
                    self.states[name] = [t["state_name"], False]
                    break
        return done

    def drop(self, name: str) -> None:
        """Forget a table, also behind its aliases."""
        del self.tables[name], self.mappings[name]
        self.states.pop(name, None)
        self.aliases = {a: [n for n in ns if n != name] for a, ns in self.aliases.items()}

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows to a table that may be written to."""
        if name in self.read_only:
            raise PermissionError(f"{name} is read-only")
        self.tables[name] = self.tables[name].unionByName(rows, allowMissingColumns=True)

    def field_caps(self, pattern: str) -> dict[str, dict[str, list[str]]]:
        """Types of each field and the tables that have it so."""
        out: dict[str, dict[str, list[str]]] = {}
        for n in self.names(pattern):
            for f in self.tables[n].schema.fields:
                out.setdefault(f.name, {}).setdefault(f.dataType.simpleString(), []).append(n)
        return out

    def validate(self, pattern: str, query: dict, id: str = "_id") -> tuple[bool, str]:  # noqa: A002
        """Whether a query can be compiled, and why not."""
        try:
            compile_query(self.scan(pattern), query, id=id)
        except (QueryError, KeyError, ValueError) as e:
            return False, str(e)
        return True, ""


def check_batch(schema: T.StructType, batch: DataFrame, mode: str) -> DataFrame:
    """A batch under a mapping's mode: ``dynamic`` adds fields, ``strict`` refuses unknown ones, ``runtime`` leaves them out."""
    extra = [c for c in batch.columns if c not in schema.names]
    if extra and mode == "strict":
        raise ValueError(f"unknown fields {extra}")
    for f in schema.fields:
        if f.name in batch.columns and batch.schema[f.name].dataType != f.dataType:
            batch = batch.withColumn(f.name, F.col(f"`{f.name}`").try_cast(f.dataType))
    return batch.drop(*extra) if mode == "runtime" else batch
