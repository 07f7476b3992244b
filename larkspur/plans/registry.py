"""Named queries with typed parameters: registration, coercion, isolation of errors."""

from __future__ import annotations

import difflib
import warnings
from collections.abc import Callable
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Tool:
    """A query with its parameters: name to (type, default or a tuple of allowed values)."""

    name: str
    run: Callable[..., DataFrame]
    params: dict[str, tuple[type, object]]


class Registry:
    """Tools by name; the first registration of a name stays, skipped names never answer."""

    def __init__(self, skip: tuple[str, ...] = (), observe: Callable[[str, float], None] | None = None):
        self.tools: dict[str, Tool] = {}
        self.skip, self.observe = set(skip), observe

    def tool(self, name: str, **params: tuple[type, object]):
        def register(run: Callable[..., DataFrame]):
            if name in self.tools:
                warnings.warn(f"{name} is registered already; the first one stays", stacklevel=2)
            elif name not in self.skip:
                self.tools[name] = Tool(name, run, params)
            return run

        return register

    def add_custom(self, entries: list) -> None:
        """Add tools or ``module:attribute`` names of tools; what cannot be used is skipped with a warning."""
        for entry in entries:
            try:
                if isinstance(entry, str):
                    module, _, attribute = entry.partition(":")
                    entry = getattr(import_module(module), attribute)
                if not isinstance(entry, Tool):
                    raise TypeError("not a tool")
            except (ImportError, AttributeError, TypeError, ValueError) as e:
                warnings.warn(f"custom tool {entry!r} skipped: {e}", stacklevel=2)
                continue
            if entry.name not in self.skip:
                self.tools.setdefault(entry.name, entry)

    def coerce(self, tool: Tool, given: dict) -> dict:
        """Arguments of their declared types; unknown names raise with the nearest known one."""
        out = {}
        for name, value in given.items():
            if name not in tool.params:
                near = difflib.get_close_matches(name, tool.params, 1)
                raise ValueError(f"unknown parameter {name}" + (f"; did you mean {near[0]}?" if near else ""))
            kind, spec = tool.params[name]
            if kind is bool and isinstance(value, str):
                value = value.strip().lower() in ("true", "1", "yes")
            elif kind is list and isinstance(value, str):
                value = [v.strip() for v in value.split(",") if v.strip()]
            elif value is not None:
                value = kind(value)
            if isinstance(spec, tuple) and kind is str:
                value = value.lower()
                if value not in spec:
                    raise ValueError(f"{name} must be one of {', '.join(spec)}")
            out[name] = value
        for name, (_, spec) in tool.params.items():
            out.setdefault(name, spec[0] if isinstance(spec, tuple) else spec)
        return out

    def call(self, spark: SparkSession, name: str, **given) -> tuple[DataFrame | None, str | None]:
        """The tool's result, or None and why; a failing tool never takes the caller down."""
        import time

        began = time.monotonic()
        if name not in self.tools:
            near = difflib.get_close_matches(name, self.tools, 1)
            return None, f"unknown tool {name}" + (f"; did you mean {near[0]}?" if near else "")
        try:
            tool = self.tools[name]
            return tool.run(spark, **self.coerce(tool, given)), None
        except Exception as e:
            return None, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
        finally:
            if self.observe:
                self.observe(name, time.monotonic() - began)
