"""skein.streaming"""
