"""Corpus operators: packing, dedup, decontamination, scoring, secrets, chat, token files."""
