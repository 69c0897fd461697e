"""Settings of an expression, fixed when it is built: coercion levels, modes, source hints, pack coercion."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum, IntEnum


class Level(IntEnum):
    """How far a value may be bent. Each level includes those below."""

    EXACT = 0
    SAFE_WIDENING = 1
    STRING_COERCION = 2
    BEST_EFFORT = 3


class Packs(Enum):
    """Which packs are tried on a string that the rules couldn't turn into a number."""

    NONE = "none"
    CURRENCY = "currency"
    UNITS = "units"
    ALL = "all"


class SourceHint(Enum):
    CSV = "csv"
    ENV = "env"
    FORM_DATA = "form_data"
    JSON = "json"
    DATABASE = "database"
    UNKNOWN = "unknown"


@dataclass(frozen=True)
class Mode:
    """What a mode does with coercion, unknown fields, missing fields and the first error."""

    name: str
    level: Level
    reject_unknown: bool
    require_all: bool
    fail_fast: bool

    @staticmethod
    def parse(text: str) -> Mode:
        """A mode by its name, whatever its case and outer blanks."""
        found = MODES.get(text.strip().lower())
        if found is None:
            raise ValueError(f"unknown mode {text!r}; one of: {', '.join(MODES)}")
        return found

    def __str__(self) -> str:
        return self.name


LENIENT = Mode("lenient", Level.BEST_EFFORT, False, False, False)
ABSORBING = Mode("absorbing", Level.SAFE_WIDENING, False, True, False)
STRICT = Mode("strict", Level.EXACT, True, True, True)
MODES = {m.name: m for m in (LENIENT, ABSORBING, STRICT)}


@dataclass(frozen=True)
class ShapeConfig:
    """Settings that a value hands on to whatever is taken out of it."""

    level: Level = Level.BEST_EFFORT
    packs: Packs = Packs.NONE
    level_set: bool = False
    packs_set: bool = False

    def with_coercion(self, level: Level) -> ShapeConfig:
        return replace(self, level=level, level_set=True)

    def with_packs(self, packs: Packs) -> ShapeConfig:
        return replace(self, packs=packs, packs_set=True)

    def with_mode(self, mode: Mode | str) -> ShapeConfig:
        return self.with_coercion((Mode.parse(mode) if isinstance(mode, str) else mode).level)

    def with_source_hint(self, hint: SourceHint) -> ShapeConfig:
        """Text sources bend everything and try all packs, unless that was set before; typed sources change nothing."""
        if hint not in (SourceHint.CSV, SourceHint.ENV, SourceHint.FORM_DATA):
            return self
        return replace(self, level=self.level if self.level_set else Level.BEST_EFFORT, packs=self.packs if self.packs_set else Packs.ALL)
