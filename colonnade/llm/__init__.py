"""Operators that prepare training data; nothing outside this folder imports them.

Each module holds one operator with a general interface; ``queries`` holds the
thin queries over the test tables.
"""
