"""graphsieve: property-graph pattern queries and corpus operators on Spark.

Names are loaded when they are used: workers import a part of the package only.
"""

from importlib import import_module

_HOMES = {
    "engine": ("Engine", "EngineError"),
    "graph": ("Graph",),
    "operators.patterns": ("And", "Any", "Call", "DominatedBy", "Field", "Identifier", "Inside", "Literal", "Method", "Not", "Or", "Parameter", "Pattern", "Return", "Var"),
    "operators.query": ("Query",),
    "rules.model": ("Confidence", "ScanRule", "Severity", "SliceRule"),
}
_NAMES = {n: m for m, names in _HOMES.items() for n in names}
__all__ = sorted(_NAMES)


def __getattr__(name: str):
    if name in _NAMES:
        return getattr(import_module(f".{_NAMES[name]}", __name__), name)
    raise AttributeError(name)
