"""Configuration of a chunk, and its text form."""
from dataclasses import dataclass

from ..errors import InvalidArgumentError

DEFAULT_LEVEL, MOST_LEVEL, MOST_ORDER = 8, 12, 7
DEFAULT_PAGE, MOST_CHUNK = 1 << 18, 1 << 24
BATCH = 256


@dataclass(frozen=True)
class ModeSpec:
    """auto, classic, float_mult (base), float_quant (k) or int_mult (base)."""

    kind: str = "auto"
    value: float | int | None = None

    @classmethod
    def parse(cls, text: str) -> "ModeSpec":
        kind, _, value = text.strip().lower().partition("@")
        named = {"floatmult": ("float_mult", float), "floatquant": ("float_quant", int), "intmult": ("int_mult", int)}
        try:
            if kind in named and value:
                name, read = named[kind]
                return cls(name, read(value))
        except ValueError as e:
            raise InvalidArgumentError(f"bad mode {text!r}") from e
        if kind in ("auto", "classic") and not value:
            return cls(kind)
        raise InvalidArgumentError(f"bad mode {text!r}")

    def __str__(self) -> str:
        return self.kind.replace("_", "") + ("" if self.value is None else f"@{self.value}")


@dataclass(frozen=True)
class DeltaSpec:
    """auto, none, consecutive (order) or lookback."""

    kind: str = "auto"
    order: int = 0

    @classmethod
    def parse(cls, text: str) -> "DeltaSpec":
        kind, _, order = text.strip().lower().partition("@")
        if kind == "consecutive" and order.isdigit():
            return cls(kind, int(order))
        if kind in ("auto", "none", "lookback") and not order:
            return cls(kind)
        raise InvalidArgumentError(f"bad delta encoding {text!r}")

    def __str__(self) -> str:
        return f"consecutive@{self.order}" if self.kind == "consecutive" else self.kind


@dataclass(frozen=True)
class Paging:
    """Pages of about equal size up to ``most``, or of the given counts."""

    most: int = DEFAULT_PAGE
    exact: tuple[int, ...] | None = None

    def counts(self, n: int) -> list[int]:
        if self.exact is not None:
            if sum(self.exact) != n:
                raise InvalidArgumentError(f"pages hold {sum(self.exact)} numbers, the chunk {n}")
            if any(c < 1 for c in self.exact):
                raise InvalidArgumentError("a page can't be empty")
            return list(self.exact)
        if self.most < 1:
            raise InvalidArgumentError("pages must hold at least one number")
        k = -(-n // self.most)
        ends = [(i + 1) * n // k for i in range(k)]
        return [b - a for a, b in zip([0, *ends], ends, strict=False)]


@dataclass(frozen=True)
class ChunkConfig:
    level: int = DEFAULT_LEVEL
    mode: ModeSpec = ModeSpec()
    delta: DeltaSpec = DeltaSpec()
    paging: Paging = Paging()

    def check(self, n: int) -> None:
        if not 0 <= self.level <= MOST_LEVEL:
            raise InvalidArgumentError(f"level {self.level} is not in 0..{MOST_LEVEL}")
        if self.delta.kind == "consecutive" and not 0 <= self.delta.order <= MOST_ORDER:
            raise InvalidArgumentError(f"order {self.delta.order} is not in 0..{MOST_ORDER}")
        if not 1 <= n <= MOST_CHUNK:
            raise InvalidArgumentError(f"a chunk holds 1 to {MOST_CHUNK} numbers, not {n}")


@dataclass(frozen=True)
class Mode:
    """How a number splits: base is a number of the type (float) or an int, k bits."""

    kind: str = "classic"
    base: float | int | None = None
    k: int = 0


@dataclass(frozen=True)
class Delta:
    kind: str = "none"
    order: int = 0
    window_log: int = 0
    state_log: int = 0
    secondary: bool = False

    @property
    def state_n(self) -> int:
        return {"none": 0, "consecutive": self.order, "lookback": 1 << self.state_log}[self.kind]
