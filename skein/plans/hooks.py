"""Events, plugins and callbacks: functions of DataFrames that a crawl calls at named points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

EVENTS = (
    "beforestart afterstart beforefinish afterfinish beforefetch afterfetch beforeconnect afterconnect beforeparse afterparse beforejsparse afterjsparse "
    "beforecssparse aftercssparse beforetag includelinks beforecrawl aftercrawl writeurl postdownload"
).split()
Handler = Callable[[DataFrame], DataFrame | Column | None]


class Hooks:
    """One handler an event. A handler of a `before` event or of writeurl returns the rows to go on with, or a condition
    on them; of an `after` event its rows replace the given ones if it returns any. `includelinks` returns a condition
    that is true to accept, false to filter, and null to go on. Plugins replace a named step, callbacks stand before or after one."""

    def __init__(self) -> None:
        self.handlers: dict[str, Handler] = {}
        self.plugins: dict[str, Callable] = {}
        self.before: dict[str, list[Callable]] = {}
        self.after: dict[str, list[Callable]] = {}

    def on(self, event: str, handler: Handler) -> Hooks:
        if event not in EVENTS:
            raise KeyError(f"no event {event}")
        self.handlers[event] = handler
        return self

    def apply(self, event: str, rows: DataFrame) -> DataFrame:
        handler = self.handlers.get(event)
        if handler is None:
            return rows
        got = handler(rows)
        return rows if got is None else rows.where(got) if isinstance(got, Column) else got

    def condition(self, event: str, rows: DataFrame) -> Column | None:
        handler = self.handlers.get(event)
        return handler(rows) if handler else None

    def plugin(self, step: str, function: Callable) -> None:
        self.plugins[step] = function

    def callback(self, step: str, function: Callable, where: str = "post") -> None:
        (self.before if where == "pre" else self.after).setdefault(step, []).append(function)

    def run(self, step: str, function: Callable, *args):
        """The step, or the plugin that replaces it, between its callbacks; post callbacks get the result."""
        for f in self.before.get(step, []):
            f(*args)
        result = self.plugins.get(step, function)(*args)
        for f in self.after.get(step, []):
            f(result)
        return result
