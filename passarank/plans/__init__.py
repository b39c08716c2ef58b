"""Physical helpers: shared scratch tables, checked broadcasts, distributed running totals."""
