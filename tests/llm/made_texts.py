"""Invented prose for fixtures."""

WORDS = "stone river lamp quiet market seven orange walks under bridge late morning paper window garden south train music north winter copper field letter summer silver castle yellow forest harbor".split()


def prose(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7919 + i * i * 31 + i * 17) % len(WORDS)] + str((seed * 31 + i * 7) % 97) for i in range(n))
