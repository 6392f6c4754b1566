"""Errors of reading and computing; the messages are part of the interface (fixed values)."""


class NoContigsLengthInformationError(Exception):
    def __init__(self):
        super().__init__("Contigs length information is required in vcf header of in compagnion file.")


class NotAVariantCsvError(Exception):
    def __init__(self, path):
        super().__init__(f"{path} seems not be a csv variant.")


class NotVcfHeaderError(Exception):
    def __init__(self):
        super().__init__("Not a vcf header")


class NotAVCFError(Exception):
    def __init__(self, path):
        super().__init__(f"File {path} seems not be a valid vcf file.")


class NoGenotypeError(Exception):
    def __init__(self):
        super().__init__("LazyFrame seems not contains genotypes.")


class NoGTError(Exception):
    def __init__(self, message: str):
        super().__init__(f"In {message} gt column is missing.")


class UnknownFormatError(Exception):
    """A FORMAT key was asked for that the header doesn't declare."""

    def __init__(self, key: str):
        super().__init__(f"FORMAT {key} isn't declared in the header.")
