"""DataFrame -> DataFrame operators (clean, groups, members, encode)."""

from . import clean, encode, groups, members

__all__ = ["clean", "encode", "groups", "members"]
