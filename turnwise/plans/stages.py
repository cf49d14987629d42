"""Stage plans: named DataFrame steps with dependencies, checked before they run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Stage:
    name: str
    run: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()
    enabled: bool = True


@dataclass
class Plan:
    stages: list[Stage] = field(default_factory=list)

    def ordered(self) -> list[Stage]:
        """Enabled stages in an order that respects their needs; raises on repeats, unknown or disabled needs, and cycles."""
        by_name = {s.name: s for s in self.stages}
        if len(by_name) < len(self.stages):
            raise ValueError("a stage is named twice")
        for s in self.stages:
            for n in s.needs:
                if n not in by_name:
                    raise ValueError(f"{s.name} needs the unknown stage {n}")
                if s.enabled and not by_name[n].enabled:
                    raise ValueError(f"{s.name} needs the disabled stage {n}")
        done: list[Stage] = []
        left = [s for s in self.stages if s.enabled]
        while left:
            ready = [s for s in left if all(any(d.name == n for d in done) for n in s.needs)]
            if not ready:
                raise ValueError("stages need each other: " + ", ".join(s.name for s in left))
            done.append(ready[0])
            left.remove(ready[0])
        return done

    def run(self, **inputs: DataFrame) -> dict[str, DataFrame]:
        """Results by stage; a stage gets the inputs for its parameters' names, and its needs in order."""
        results: dict[str, DataFrame] = dict(inputs)
        for s in self.ordered():
            results[s.name] = s.run(*[results[n] for n in s.needs]) if s.needs else s.run(**inputs)
        return results
