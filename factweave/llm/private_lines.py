"""Lines of plain writing, by hand, that decide the thresholds of personal data: <kind|value> marks a value that a reader would call private.

They are independent of the generator that writes the trees' examples. Numbers that only look alike are left unmarked.
"""

LINES = """
Please ring me on <phone|(0171) 2345678> after six.
My phone is <phone|0171 2345678>, I rarely pick up before noon.
You can call <phone|0049 171 2345678> from abroad.
tel <phone|030 1234567>
Tel.: <phone|030/1234567>, Fax: <phone|030/1234568>
Mobile <phone|07700 900123> works best on weekdays.
Her mobile number, <phone|07700 900 456>, was on the back of the card.
Telefon <phone|089 2345678>, bitte nach 18 Uhr.
Telefono <phone|06 69821234> oppure passate in ufficio.
We were told to dial <phone|0033 1 42 68 53 00> and wait.
The cell is <phone|312-555-0147> and the office is <phone|(312) 555-0188>.
Call <phone|1-800-555-0199> for help, day or night.
phone: <phone|415.555.0132>
Reach the desk at <phone|(415)555-0111>.
fax <phone|0221 4701234>
If nobody answers, call 999 instead.
The phone sold for 1299 and the case for 49.
Phone lines opened in 1987 and closed in 2003.
Call number 823.912 is on the second shelf.
Order 0171 2345678 was shipped on 12.03.2021.
Invoice 0049 171 2345678 is still unpaid.
The serial 030 1234567 is engraved below the lens.
Section 12.4.1 of build 4.15.0.112 explains the error.
Version 10.2.300.4001 came out in June.
ISBN 978-3-16-148410-0 and ISBN 0-306-40615-2 were both reprinted.
Item 415.555.0132 is out of stock.
Between 1914-1918 and 1939-1945 the mill stood still.
Pages 312-555 were missing, and so was chapter 12.
We counted 1 234 567 birds, then 2 345 678 more.
Add 250 500 750 to the column and carry 1.
The score was 21-19, 18-21, 22-20.
On 2021-03-12 at 10:45:33 the tide was 3.25 m.
The map reference is 51 30 26 and 0 7 39.
The population rose from 3 769 495 to 3 850 809.
Part no 4111 2222 3333 4445 does not fit.
Order id 5500 0000 0000 0005 was cancelled.
Pay with card <card|4111.1111.1111.1111> before Friday.
visa <card|4012/8888/8888/1881> exp 09/27
Credit card: <card|5555_5555_5555_4444>, name as printed.
My mastercard is <card|5105--1051--0510--5100>, do not lose it.
They charged <card|3782 822463 10005> twice.
Karte <card|4222.2222.2222.2220> wurde gesperrt.
The carte number is <card|6011/1111/1111/1117>.
Tracking 1Z 999 999 0123 456784 is on its way.
The receipt says 0000 0000 0000 0000 in faded ink.
Payment of 1 500 000 was made in 12 parts.
The server is at <ip|192[.]168[.]0[.]25>.
Login came from <ip|10 . 0 . 0 . 77> twice.
Block <ip|203(.)0(.)113(.)9> at the gate.
host <ip|198[.]51[.]100[.]23> does not answer ping
Client <ip|172 . 16 . 254 . 1> was refused.
Figure 4 . 2 . 1 . 300 shows nothing of the kind.
Release 300[.]1[.]2[.]3 was withdrawn.
Verses 1 . 2 . 3 of the song are lost.
Write to <email|anna.berg(at)example.org> for the recipe.
mail <email|j.doe [at] example [dot] com> any time
Contact <email|sales at example dot net> about the loft.
My address is <email|k_lind{at}example.de>.
correo: <email|luz.mar(at)ejemplo(dot)es>
courriel <email|jean [at] exemple [dot] fr>, merci
We met at noon dot on the hour.
She stood at door dot dot dot and waited.
He was good at chess dot com sites bored him.
Look at example dot and move on.
The at sign (at) is older than the dot (dot).
"""


def examples() -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Each line, and the kind, start and end of its values."""
    out = []
    for line in filter(None, LINES.split("\n")):
        text, spans = "", []
        for piece in line.split("<"):
            if "|" in piece:
                kind, rest = piece.split("|", 1)
                value, rest = rest.split(">", 1)
                spans.append((kind, len(text), len(text) + len(value)))
                piece = value + rest
            text += piece
        out.append((text, spans))
    return out
