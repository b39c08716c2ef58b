"""Registered queries with their SQL twins. Each reads whole tables of a data folder."""
