"""Kernels over one floor's bitmaps; Spark deals floors to tasks, see atriumq.plans."""
