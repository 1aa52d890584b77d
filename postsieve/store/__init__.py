"""The append-only store."""

from postsieve.store.folders import shared_folder
from postsieve.store.tables import ListingStore

__all__ = ["ListingStore", "shared_folder"]
