"""The contract of components and the registry that names them."""

from __future__ import annotations

import inspect
import json

from pyspark.sql import DataFrame

COMPONENTS: dict[str, type[Component]] = {}


class Component:
    """A step that learns from a table in ``fit`` and rewrites tables in ``transform``.

    Learnt state is small (statistics of columns, never rows) and is all in ``state``, so components store as JSON.
    ``training_only`` components rewrite the rows of training tables and pass others through; ``modifies_target`` ones
    change the label column and have ``inverse_transform``.
    """

    training_only = False
    modifies_target = False
    hyperparameters: dict = {}

    def __init_subclass__(cls, **kwargs):
        super().__init_subclass__(**kwargs)
        COMPONENTS[cls.__name__] = cls

    def __init__(self, **parameters):
        known = {k: p.default for k, p in inspect.signature(self.fit_state).parameters.items() if p.default is not inspect.Parameter.empty and k != "y"}
        unknown = set(parameters) - set(known)
        if unknown:
            raise ValueError(f"{type(self).__name__} has no parameters {sorted(unknown)}")
        self.parameters = known | parameters
        self.state: dict | None = None

    def fit_state(self, df: DataFrame, y: str | None = None) -> dict:
        """What the component learns; keyword parameters are the component's parameters."""
        return {}

    def fit(self, df: DataFrame, y: str | None = None) -> Component:
        self.state = self.fit_state(df, y=y, **self.parameters) | {"y": y}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def fit_transform(self, df: DataFrame, y: str | None = None) -> DataFrame:
        return self.fit(df, y).transform(df)

    def learnt(self) -> dict:
        if self.state is None:
            raise ValueError(f"{type(self).__name__} has not been fitted")
        return self.state

    def clone(self) -> Component:
        return type(self)(**self.parameters)

    def describe(self) -> dict:
        return {"name": type(self).__name__, "parameters": dict(self.parameters)}

    def to_json(self) -> str:
        return json.dumps({"component": type(self).__name__, "parameters": self.parameters, "state": self.state}, default=str)

    @staticmethod
    def from_json(text: str) -> Component:
        got = json.loads(text)
        out = COMPONENTS[got["component"]](**got["parameters"])
        out.state = got["state"]
        return out


def features_of(df: DataFrame, y: str | None) -> list[str]:
    return [c for c in df.columns if c != y]


def component(name: str | type[Component]) -> type[Component]:
    """A component class by name; raises for unknown ones."""
    if isinstance(name, type):
        return name
    if name not in COMPONENTS:
        raise ValueError(f"no component {name!r}")
    return COMPONENTS[name]


def all_components() -> dict[str, type[Component]]:
    """Every component by name."""
    return dict(sorted(COMPONENTS.items()))


def component_code(step: Component) -> str:
    """Python that builds a component anew."""
    if not isinstance(step, Component):
        raise ValueError("code is made for components only")
    kind = type(step)
    given = ", ".join(f"{k}={v!r}" for k, v in step.parameters.items())
    return f"from {kind.__module__} import {kind.__name__}\n\n{kind.__name__[0].lower()}{kind.__name__[1:]} = {kind.__name__}({given})\n"
