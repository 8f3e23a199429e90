"""skein.functions"""
