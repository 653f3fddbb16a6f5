"""Pieces of check SQL for boxes a and b, given as table aliases."""


def area(a):
    return f"(greatest(0.0, {a}.x1 - {a}.x0) * greatest(0.0, {a}.y1 - {a}.y0))"


def inter(a, b):
    return f"(greatest(0.0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0.0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0)))"


def share(a, b):
    return f"(CASE WHEN {area(a)} > 0 THEN {inter(a, b)} / {area(a)} ELSE 0.0 END)"


def iou(a, b):
    return f"(CASE WHEN {inter(a, b)} > 0 THEN {inter(a, b)} / ({area(a)} + {area(b)} - {inter(a, b)}) ELSE 0.0 END)"


def coef(a, b):
    return f"({inter(a, b)} / least(greatest(1.0, {area(a)}), greatest(1.0, {area(b)})))"


def centre_in(a, b, pad=0.0):
    return f"(({a}.x0 + {a}.x1) / 2 BETWEEN {b}.x0 - {pad} AND {b}.x1 + {pad} AND ({a}.y0 + {a}.y1) / 2 BETWEEN {b}.y0 - {pad} AND {b}.y1 + {pad})"
