"""The catalogue: a bundle of DataFrames, one per table of the data model.

Column contracts (ids may be any orderable type; flags are booleans):

* ``restaurants``          id, name, opinion, verified, address, updated_by, verified_by, deleted
* ``cuisines``             id, type
* ``restaurant_cuisines``  id_restaurant, id_cuisine            (duplicates allowed)
* ``dishes``               id, name, calories, price, weight, vegetarian, vegan
* ``menu``                 id_restaurant, id_dish, verified, updated_by, verified_by, deleted
* ``ingredients``          id, name, vegetarian, vegan
* ``dish_ingredients``     id_ingredient, id_dish               (duplicates allowed)
* ``allergens``            id, name
* ``ingredient_allergens`` id_allergen, id_ingredient           (duplicates allowed)
* ``coordinates``          id, verified, lat, lon, pending_lat, pending_lon,
                           updated_by, verified_by, edited_by
* ``hours``                id, id_restaurant, mon..sun, special map<string,string>,
                           updated_by, verified_by, verified, deleted
* ``comments``             id, comment, score, verified, updated_by, verified_by, deleted
* ``restaurant_comments``  id_restaurant, id_comment
* ``users``                id, login, email, username, is_admin
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")


@dataclass(frozen=True)
class Catalog:
    restaurants: DataFrame
    cuisines: DataFrame
    restaurant_cuisines: DataFrame
    dishes: DataFrame
    menu: DataFrame
    ingredients: DataFrame
    dish_ingredients: DataFrame
    allergens: DataFrame
    ingredient_allergens: DataFrame
    coordinates: DataFrame
    hours: DataFrame
    comments: DataFrame
    restaurant_comments: DataFrame
    users: DataFrame

    def with_tables(self, **tables: DataFrame) -> "Catalog":
        """A new catalogue with some tables replaced (snapshots are immutable)."""
        return replace(self, **tables)


class LazyCatalog:
    """A catalogue whose tables are built on first use.

    Same attributes and ``with_tables`` as :class:`Catalog`; a query that
    touches five tables never analyses the plans of the other nine.
    """

    _FIELDS = tuple(Catalog.__dataclass_fields__)

    def __init__(self, builders, overrides=None):
        self._builders = builders
        self._built = dict(overrides or {})

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._FIELDS:
            raise AttributeError(name)
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def with_tables(self, **tables: DataFrame) -> "LazyCatalog":
        return LazyCatalog(self._builders, {**self._built, **tables})

    def materialized(self) -> Catalog:
        """All tables as a plain :class:`Catalog`."""
        return Catalog(**{f: getattr(self, f) for f in self._FIELDS})
