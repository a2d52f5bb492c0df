"""Operators for preparing training text: near and exact de-duplication, filters,
tokenizing, record output, chat formatting, decontamination.  Nothing outside this
subpackage imports it."""
