"""Model backends by name: how to load them, whether they answer, and what models they have."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Backend:
    """`load` gives the model (a callable) where it runs; `health` and `models` may raise, which counts as no."""

    id: str
    label: str
    load: Callable[[], Callable]
    health: Callable[[], bool] = lambda: True
    models: Callable[[], list[str]] = lambda: []
    local: bool = False
    temperature: float = 0.3


@dataclass(frozen=True)
class Registry:
    """Backends by id; the first one is the default."""

    backends: tuple[Backend, ...] = field(default=())

    def with_backend(self, b: Backend) -> Registry:
        return Registry(tuple(x for x in self.backends if x.id != b.id) + (b,))

    def get(self, id: str | None = None) -> Backend:
        found = [b for b in self.backends if id is None or b.id == id]
        if not found:
            raise KeyError(f"no backend {id!r}")
        return found[0]

    def with_temperature(self, t: float) -> Registry:
        """All backends at this temperature, clamped to 0 to 1."""
        return Registry(tuple(replace(b, temperature=min(max(t, 0.0), 1.0)) for b in self.backends))

    def status(self, spark: SparkSession) -> DataFrame:
        """id, label, available, models (empty where the backend can't be asked)."""

        def asked(f, otherwise):
            try:
                return f()
            except Exception:  # noqa: BLE001  a backend that is down is an answer
                return otherwise

        rows = [(b.id, b.label, bool(asked(b.health, False)), list(asked(b.models, []))) for b in self.backends]
        return spark.createDataFrame(rows, "id string, label string, available boolean, models array<string>")
