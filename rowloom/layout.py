"""Names of the columns that carry row identity, label and role."""

from __future__ import annotations

from dataclasses import dataclass

TRAIN = "train"
TEST = "test"


@dataclass(frozen=True)
class Layout:
    """Reserved column names of a tagged table.

    Rows are identified by ``id`` and marked train or test by ``split``; nothing
    in this library relies on row positions.
    """

    id: str = "id"
    label: str = "target"
    split: str = "split"
    fold: str = "fold"
    weight: str = "weight"

    @property
    def reserved(self) -> frozenset[str]:
        return frozenset((self.id, self.label, self.split, self.fold, self.weight))


DEFAULT = Layout()
