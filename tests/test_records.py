"""Dataclasses as documents."""

import enum
from dataclasses import dataclass, field

import pytest
from docloom import errors as E
from docloom.functions.records import IntegerInvalid, from_document, to_document


class Mood(enum.Enum):
    calm = 1
    loud = 2


@dataclass
class Profile:
    age: int
    tags: list[str] = field(default_factory=list)


@dataclass
class Person:
    name: str
    profile: Profile
    mood: Mood = Mood.calm
    nick: str | None = None


@dataclass
class Circle:
    r: float


@dataclass
class Empty:
    pass


@dataclass
class Drawing:
    shape: Circle | Empty


def test_round_trip():
    p = Person("a", Profile(3, ["x"]), Mood.loud)
    d = to_document(p)
    assert d == {"name": "a", "profile": {"age": 3, "tags": ["x"]}, "mood": "loud", "nick": None}
    assert from_document(Person, d) == p
    assert from_document(Person, {"name": "b", "profile": {"age": 2.0}}) == Person("b", Profile(2))
    assert from_document(Drawing, {"shape": {"Circle": {"r": 1}}}).shape == Circle(1.0) and from_document(Drawing, {"shape": "Empty"}).shape == Empty()


def test_errors():
    for target, value, error in [
        (Profile, {"age": float("nan")}, IntegerInvalid),
        (Profile, {"age": 2.0**63}, E.IntegerOverflow),
        (Profile, {}, E.InvalidFormat),
        (Profile, 1, E.InvalidFormat),
        (Person, {"name": 1, "profile": {"age": 1}}, E.InvalidFormat),
        (Mood, "angry", E.InvalidFormat),
        (Drawing, {"shape": {"Square": {}}}, E.InvalidFormat),
    ]:
        with pytest.raises(error):
            from_document(target, value)
