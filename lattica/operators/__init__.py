"""Importing this package registers the catalog queries."""

from . import collecting, compositions, crates, discover, entities, explore, fit, folds, fulltext, hubstore, inscriptions, insights, ledger, lookup, paths, pressings, profiles, pursuit, rarity, scopes, search, similarity, strata, temporal, trends  # noqa: F401
from .. import sources, streaming  # noqa: F401
from ..streaming import sync  # noqa: F401
