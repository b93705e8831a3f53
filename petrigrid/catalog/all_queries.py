"""Import every query module so that it registers its entries."""

import importlib
import pkgutil

import petrigrid.catalog as _pkg

_names = [m.name for m in pkgutil.iter_modules(_pkg.__path__)]
# q_sources reuses oracle texts of the others
for _m in sorted(_names, key=lambda n: (n == "q_sources", n)):
    if _m.startswith("q_"):
        importlib.import_module(f"petrigrid.catalog.{_m}")
