"""Column names and types of the tables that operators work on.

Every operator takes the columns that it names and leaves others alone. Unsigned numbers are held in the
next larger signed type; all-ones sentinels are null.
"""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, MapType, StringType, StructField, StructType


def _struct(**fields) -> StructType:
    return StructType([StructField(n, t) for n, t in fields.items()])


EXTENT = _struct(offset=LongType(), count=LongType())

#: One row for each name in a tree. path is canonical, '' for the root; target is a link's text or file.
ENTRIES = _struct(
    path=StringType(), mode=IntegerType(), uid=LongType(), gid=LongType(), mtime=LongType(), size=LongType(), rdev=LongType(), target=StringType(), hard_link=BooleanType(),
    dev=LongType(), inode=LongType(), seq=LongType(), content=BinaryType(), xattrs=MapType(StringType(), BinaryType()), sparse=ArrayType(EXTENT),
)

SUPER = _struct(
    image=StringType(), inode_count=LongType(), mtime=LongType(), block_size=LongType(), fragment_count=LongType(), compressor=IntegerType(), block_log=IntegerType(), flags=IntegerType(), id_count=IntegerType(),
    major=IntegerType(), minor=IntegerType(), root_ref=LongType(), bytes_used=LongType(), id_table=LongType(), xattr_table=LongType(), inode_table=LongType(), directory_table=LongType(),
    fragment_table=LongType(), export_table=LongType(),
)

DIR_INDEX = _struct(index=LongType(), start=LongType(), name=StringType())

INODES = _struct(
    image=StringType(), inode=LongType(), ref=LongType(), type=IntegerType(), mode=IntegerType(), uid_index=IntegerType(), gid_index=IntegerType(), mtime=LongType(), nlink=LongType(), size=LongType(),
    block_start=LongType(), fragment=LongType(), fragment_offset=LongType(), sparse_bytes=LongType(), xattr_index=LongType(), block_sizes=ArrayType(LongType()), target=StringType(), rdev=LongType(),
    dir_start=LongType(), dir_offset=LongType(), parent_inode=LongType(), dir_index=ArrayType(DIR_INDEX),
)

DIRENTS = _struct(image=StringType(), parent_inode=LongType(), name=StringType(), inode=LongType(), ref=LongType(), type=IntegerType(), position=LongType())
FRAGMENTS = _struct(image=StringType(), idx=LongType(), start=LongType(), stored=LongType(), compressed=BooleanType())
IDS = _struct(image=StringType(), idx=IntegerType(), id=LongType())
XATTRS = _struct(image=StringType(), xattr_index=LongType(), position=IntegerType(), key=StringType(), value=BinaryType())
EXPORT = _struct(image=StringType(), inode=LongType(), ref=LongType())
BLOCKS = _struct(image=StringType(), inode=LongType(), idx=LongType(), at=LongType(), stored=LongType(), compressed=BooleanType(), sparse=BooleanType(), data=BinaryType())
