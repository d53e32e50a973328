"""Operators that prepare training text; nothing else in loomrow imports them."""
